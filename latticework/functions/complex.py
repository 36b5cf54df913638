"""Complex numbers as struct<re: double, im: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cx(re, im=0.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(re).cast("double").alias("re"), as_col(im).cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return cx(a["re"] + b["re"], a["im"] + b["im"])


def mul(a: Column, b: Column) -> Column:
    return cx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return cx(a["re"], -a["im"])


def norm_sqr(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def modulus(a: Column) -> Column:
    return F.sqrt(norm_sqr(a))


def expi(t: Column) -> Column:
    return cx(F.cos(t), F.sin(t))


def inner(a: Column, b: Column) -> Column:
    """conj(a) * b, to be summed."""
    return mul(conj(a), b)
