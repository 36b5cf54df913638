"""Right-hand sides of boundary problems: incident data of sources or waves, sampled at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import kernels as K
from latticework.functions.complex import cx
from latticework.functions.draws import uniform
from latticework.operators.matrix import Operator, all_pairs, between, block_number, combine

DIRICHLET, ANY = ("Dirichlet",), ("Dirichlet", "Neumann")
#: Beginnings of the names of operators whose right-hand sides are random.
RANDOM = ("BasicStructuredOperator", "KiFMM", "BemppClLaplaceSingleLayerCPID", "BemppClHelmholtzSingleLayerCPID", "BIEGrid")
#: Beginnings of the names of the other operators, what their data come from, and the problems they know.
KINDS = {
    "BemppClLaplaceSingleLayer": ("single_layer", DIRICHLET),
    "BemppClLaplaceCombined": ("monopole", ANY),
    "BemppClLaplaceSecond": ("monopole", ANY),
    "BemppClHelmholtzSingleLayer": ("wave", DIRICHLET),
    "BemppClHelmholtzCombined": ("combined", DIRICHLET),
    "BemppClBurtonMiller": ("burton_miller", ANY),
    "BemppClMaxwellEfie": ("polarised", ANY),
}


def _wave_value(kind: str, kappa: float) -> Column:
    """Value of a wave of direction q at a point p with normal (nx, ny, nz)."""
    phase = F.expr("p.x * q.x + p.y * q.y + p.z * q.z")
    if kind == "wave":
        return K.plane_wave(phase, kappa)
    along = F.expr("p.nx * q.x + p.ny * q.y + p.nz * q.z")
    if kind == "burton_miller":
        return K.burton_miller(K.plane_wave(phase, kappa), K.plane_wave_normal(phase, along, kappa), kappa)
    return cx(-kappa * (along - 1) * F.sin(kappa * phase), kappa * (along - 1) * F.cos(kappa * phase))


def right_hand_side(points: DataFrame, operator: str, sources: DataFrame, problem: str = "Dirichlet", kappa: float = 0.0, precision: str = "double", double_layer: Operator | None = None, seed: int = 42) -> DataFrame:
    """vec, idx, re, im: a vector over points for each row of sources, by the name of an operator.

    points: id, x, y, z, and the normal nx, ny, nz where waves need it. sources: id, x, y, z, places of charges for
    Laplace operators, directions of waves for the others. Laplace single layers apply D - I / 2 to the potential, D
    being the adjoint double layer given. Maxwell data are tangential vectors: idx is 3 id + component. Operators of
    RANDOM get uniform draws, real ones for Laplace. precision single rounds to 32 bits. Unknown operators, problems
    and precisions are errors.
    """
    if precision not in ("single", "double"):
        raise ValueError(f"precision must be single or double, not {precision!r}")
    real, n = "Laplace" in operator or "Real" in operator, sources.count()
    if operator.startswith(RANDOM):
        own = all_pairs(points, sources, block_number(sources, n)).select(F.col("q.id").alias("vec"), F.col("p.id").alias("idx"))
        draw = lambda t: uniform(seed, F.col("vec"), F.col("idx"), t)
        return _cast(own.select("vec", "idx", draw("r").alias("re"), (F.lit(0.0) if real else draw("i")).alias("im")), precision)
    kind, problems = next((v for k, v in KINDS.items() if operator.startswith(k)), (None, ()))
    if kind is None:
        raise ValueError(f"no right-hand side for operator {operator!r}; known: {sorted(KINDS)}")
    if problem not in problems:
        raise ValueError(f"no right-hand side for the {problem} problem of {operator}")
    pairs = all_pairs(points, sources, block_number(sources, n))
    vec, idx = F.col("q.id").alias("vec"), F.col("p.id").alias("idx")
    if kind in ("monopole", "single_layer"):
        out = pairs.select(vec, idx, K.monopole(between()).alias("v")).select("vec", "idx", "v.re", "v.im")
        if kind == "single_layer":
            if double_layer is None:
                raise ValueError(f"{operator} needs its adjoint double layer")
            out = combine([(1, double_layer.apply(out).select("vec", "idx", "re", "im")), (-0.5, out)], ["vec", "idx"])
        return _cast(out, precision)
    if kind == "polarised":
        phase, normal = F.expr("p.x * q.x + p.y * q.y + p.z * q.z"), [F.col(f"p.n{c}") for c in "xyz"]
        # the incident field is a scalar wave times (-1, 0, 0), so is its cross product with the normal
        turned = K.cross([F.lit(-1.0), F.lit(0.0), F.lit(0.0)], normal)
        own = pairs.select(vec, F.col("p.id").alias("id"), F.cos(kappa * phase).alias("c"), F.sin(kappa * phase).alias("s"), F.posexplode(F.array(*turned)).alias("k", "t"))
        return _cast(own.select("vec", (3 * F.col("id") + F.col("k")).alias("idx"), (F.col("t") * F.col("c")).alias("re"), (F.col("t") * F.col("s")).alias("im")), precision)
    return _cast(pairs.select(vec, idx, _wave_value(kind, kappa).alias("v")).select("vec", "idx", "v.re", "v.im"), precision)


def _cast(x: DataFrame, precision: str) -> DataFrame:
    return x.withColumns({c: F.col(c).cast("float") for c in ("re", "im")}) if precision == "single" else x
