"""Kernels as functions of a distance, and data on points that sources or directions cause."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.complex import cx

KERNELS: dict[str, Callable[[Column, Column, float], Column]] = {}


def kernel(name: str):
    """Registers fn(distance, number of points, wave number) -> struct<re, im> under a name."""

    def put(fn):
        KERNELS[name] = fn
        return fn

    return put


def _one_at_zero(d: Column, value: Column) -> Column:
    return F.when(d == 0, cx(1.0)).otherwise(value)


def _safe(d: Column) -> Column:
    return F.when(d == 0, 1.0).otherwise(d)


@kernel("gaussian")
def gaussian(d, n, kappa):
    return _one_at_zero(d, cx(1 / (n * F.exp(d * d))))


@kernel("oscillating_gaussian")
def oscillating_gaussian(d, n, kappa):
    return _one_at_zero(d, cx(F.cos(d * d) / n, -F.sin(d * d) / n))


@kernel("laplace")
def laplace(d, n, kappa):
    return _one_at_zero(d, cx(1 / (4 * math.pi * n * _safe(d))))


@kernel("helmholtz")
def helmholtz(d, n, kappa):
    return _one_at_zero(d, cx(F.cos(kappa * d) / (4 * math.pi * n * _safe(d)), F.sin(kappa * d) / (4 * math.pi * n * _safe(d))))


def lookup(name: str) -> Callable[[Column, Column, float], Column]:
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {sorted(KERNELS)}")
    return KERNELS[name]


def values(name: str, n: int, kappa: float) -> Callable[[np.ndarray], tuple[np.ndarray | float, np.ndarray | float]]:
    """The registered kernel of that name as a function of an array of distances, for sums inside tasks: real and imaginary parts."""
    if name not in ("gaussian", "oscillating_gaussian", "laplace", "helmholtz"):
        raise ValueError(f"kernel {name!r} has no array form")

    def each(d):
        zero = d == 0
        some = np.where(zero, 1.0, d)
        if name == "gaussian":
            re, im = np.exp(-d * d) / n, None
        elif name == "oscillating_gaussian":
            re, im = np.cos(d * d) / n, -np.sin(d * d) / n
        elif name == "laplace":
            re, im = 1 / (4 * math.pi * n * some), None
        else:
            size = 1 / (4 * math.pi * n * some)
            re, im = np.cos(kappa * d) * size, np.sin(kappa * d) * size
        re[zero] = 1.0
        if im is None:
            im = np.zeros_like(re)
        im[zero] = 0.0
        return re, im

    return each


def grid_values(d: np.ndarray, n: int, ndim: int) -> np.ndarray:
    """grid_kernel of an array of distances."""
    some = np.where(d == 0, 1.0, d)
    return np.where(d == 0, 0.0, (-np.log(some) / (2 * math.pi) if ndim == 2 else 1 / (4 * math.pi * some)) / n)


def grid_kernel(r: Column, n: Column, ndim: int) -> Column:
    """-(1/2pi) ln r in the plane, (1/4pi)/r in space, over n; 0 at r = 0."""
    value = -F.ln(_safe(r)) / (2 * math.pi) if ndim == 2 else 1 / (4 * math.pi * _safe(r))
    return F.when(r == 0, 0.0).otherwise(value / n)


def grid_diagonal(h: float, ndim: int) -> float:
    """Integral of the kernel over a cell of width h around its pole."""
    a = h / 2
    if ndim == 2:
        return -(2 / math.pi) * a * a * (math.log(a) + math.log(2) / 2 - 1.5 + math.pi / 4)
    return (2 / math.pi) * a * a * (1.5 * math.log(2 + math.sqrt(3)) - math.pi / 4)


def distance(x0, y0, z0, x1, y1, z1) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1) + (z0 - z1) * (z0 - z1))


def monopole(r: Column) -> Column:
    """Potential of a unit source at distance r."""
    return cx(1 / (4 * math.pi * r))


def plane_wave(phase: Column, kappa: float) -> Column:
    """Trace -exp(i kappa d.x) of an incident wave; phase is d.x."""
    return cx(-F.cos(kappa * phase), -F.sin(kappa * phase))


def plane_wave_normal(phase: Column, along: Column, kappa: float) -> Column:
    """Normal derivative of the trace: -i kappa (d.n) exp(i kappa d.x); along is d.n."""
    return cx(kappa * along * F.sin(kappa * phase), -kappa * along * F.cos(kappa * phase))


def combined(trace: Column, normal: Column, coupling: float) -> Column:
    """normal - i coupling trace, the data of a combined formulation."""
    return cx(normal["re"] + coupling * trace["im"], normal["im"] - coupling * trace["re"])


def burton_miller(trace: Column, normal: Column, kappa: float) -> Column:
    """trace + (i / kappa) normal."""
    return cx(trace["re"] - normal["im"] / kappa, trace["im"] + normal["re"] / kappa)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    """Cross product of two vectors, as for polarised waves and normals."""
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
