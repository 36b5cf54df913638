"""Norms, defects and errors from samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from latticework.operators.matrix import Operator, StoredMatrix, TiledMatrix, apply_matrix, compared, difference, transpose
from latticework.session import Scratch

FLOOR = 1e-14


def norms(x: DataFrame) -> DataFrame:
    """vec, norm."""
    return x.groupBy("vec").agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("norm"))


def frobenius_estimate(images: DataFrame) -> DataFrame:
    """fro: sqrt(sum of squared image norms / number of samples)."""
    return norms(images).agg(F.sqrt(F.sum(F.col("norm") ** 2) / F.count("*")).alias("fro"))


def relative_difference(reference: DataFrame, other: DataFrame) -> DataFrame:
    """rel: Frobenius estimate of the difference over that of the reference, which is 1e-14 at least."""
    a, b = frobenius_estimate(compared(reference, other)), frobenius_estimate(reference)
    return a.select(F.col("fro").alias("d")).crossJoin(b.select(F.col("fro").alias("r"))).select((F.col("d") / F.greatest("r", F.lit(FLOOR))).alias("rel"))


def sample_errors(reference: DataFrame, other: DataFrame, inverse: bool = False) -> DataFrame:
    """vec, err: norm of the difference over that of the reference; without a reference 1 forward, the plain norm for inverses."""
    both = norms(compared(reference, other)).withColumnRenamed("norm", "d").join(norms(reference), "vec")
    return both.select("vec", F.when(F.col("norm") > 0, F.col("d") / F.col("norm")).otherwise(F.col("d") if inverse else F.lit(1.0)).alias("err"))


def max_error(reference: DataFrame, other: DataFrame, inverse: bool = False) -> DataFrame:
    return sample_errors(reference, other, inverse).agg(F.max("err").alias("max_err"))


def sided_errors(a, approximate, inverse, w: DataFrame) -> DataFrame:
    """side, kind, max_err: the largest relative errors of an approximation of a and of an approximate inverse over samples w.

    The left ones apply a B w to A w, relative to B w, and C A w to w; the right ones the transposes, B^T w to A^T w,
    relative to that, and A^T C^T w to w. A zero reference counts 1 forward, and the plain norm for inverses. a,
    approximate and inverse are matrices, stored or tiled ones too.
    """
    scratch = Scratch(w.sparkSession, "sided")
    w = scratch.table(w, "w")
    image = lambda m, x, name, mode="none": scratch.table(apply_matrix(m, x, mode), name)  # noqa: E731  stored, so no product is done twice
    left, right = image(a, w, "left"), image(a, w, "right", "transpose")
    back = image(inverse, w, "inverse-right", "transpose")
    each = [
        ("left", "forward", max_error(image(approximate, w, "near-left"), left)),
        ("right", "forward", max_error(right, image(approximate, w, "near-right", "transpose"))),
        ("left", "inverse", max_error(w, image(inverse, left, "inverse-left"), True)),
        ("right", "inverse", max_error(w, image(a, back, "back-right", "transpose"), True)),
    ]
    return reduce(DataFrame.unionByName, (df.select(F.lit(side).alias("side"), F.lit(kind).alias("kind"), "max_err") for side, kind, df in each))


def route_consistency(op: Operator, ids: DataFrame, x: DataFrame) -> DataFrame:
    """transpose_route, symmetry_defect, imaginary_share and adjoint_route of an operator: whether its ways of applying it agree.

    The operator is assembled by its plain and by its transposed route, on a basis vector for each of ids, which is for
    small ones; the relative Frobenius difference of the latter to the exact transpose is transpose_route. adjoint_route is
    the largest relative difference of A* x to conj(A^T conj(x)) over the vectors of x. Denominators are 1e-14 at least.
    """
    basis = ids.select(F.col("id").alias("vec"), F.col("id").alias("idx"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    scratch = Scratch(ids.sparkSession, "routes")
    plain, route = (scratch.table(op.apply(basis, mode).select(F.col("idx").alias("i"), F.col("vec").alias("j"), "re", "im"), mode) for mode in ("none", "transpose"))
    size = lambda m, *c: m.agg(F.sqrt(F.sum(sum(F.col(n) ** 2 for n in c))).alias("n"))
    ratio = lambda top, bottom, name: top.select(F.coalesce("n", F.lit(0.0)).alias("p")).crossJoin(bottom).select((F.col("p") / F.greatest(F.coalesce("n", F.lit(0.0)), F.lit(FLOOR))).alias(name))  # noqa: E731  one row each
    whole = size(plain, "re", "im")
    flip = lambda v: v.withColumn("im", -F.col("im"))
    adjoint = max_error(op.apply(x, "adjoint"), flip(op.apply(flip(x), "transpose"))).select(F.coalesce("max_err", F.lit(0.0)).alias("adjoint_route"))
    out = ratio(size(difference(route, transpose(plain)), "re", "im"), whole, "transpose_route")
    return out.crossJoin(ratio(size(difference(plain, transpose(plain)), "re", "im"), whole, "symmetry_defect")).crossJoin(ratio(size(plain, "im"), whole, "imaginary_share")).crossJoin(adjoint)


def dots(x: DataFrame, y: DataFrame) -> DataFrame:
    """vec, re, im of <x, y>, the left one conjugated."""
    both = x.alias("x").join(y.alias("y"), ["vec", "idx"])
    return both.groupBy("vec").agg(F.expr("sum(x.re * y.re + x.im * y.im)").alias("re"), F.expr("sum(x.re * y.im - x.im * y.re)").alias("im"))


def adjoint_defect(a: DataFrame, x: DataFrame, y: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """defect: the largest |<x, A y> - <B x, y>| over the larger of both moduli and 1e-14; B is the claimed adjoint, or A*."""
    back = apply_matrix(a, x, "adjoint") if claimed is None else apply_matrix(claimed, x)
    p, q = dots(x, apply_matrix(a, y)), dots(back, y)
    both = p.alias("p").join(q.alias("q"), "vec")
    size = lambda s: F.sqrt(F.expr(f"{s}.re * {s}.re + {s}.im * {s}.im"))
    gap = F.sqrt((F.col("p.re") - F.col("q.re")) ** 2 + (F.col("p.im") - F.col("q.im")) ** 2)
    return both.agg(F.max(gap / F.greatest(size("p"), size("q"), F.lit(FLOOR))).alias("defect"))


def self_adjoint_defect(a: DataFrame, x: DataFrame) -> DataFrame:
    """defect: the largest |A x - A* x| / |A x|."""
    return sample_errors(apply_matrix(a, x), apply_matrix(a, x, "adjoint")).agg(F.max("err").alias("defect"))


def two_norm_estimate(a: DataFrame, x: DataFrame) -> DataFrame:
    """norm_2: the largest |A x| / |x| over the samples."""
    both = norms(apply_matrix(a, x)).withColumnRenamed("norm", "ax").join(norms(x), "vec").where("norm > 0")
    return both.agg(F.max(F.col("ax") / F.col("norm")).alias("norm_2"))


def solve_check(a: DataFrame, x: DataFrame, approximate: DataFrame, b: DataFrame) -> DataFrame:
    """vec, err (of the solution) and residual (|b - A x'| / |b|)."""
    err = sample_errors(x, approximate)
    return err.join(sample_errors(b, apply_matrix(a, approximate)).withColumnRenamed("err", "residual"), "vec")


def derived(stats: DataFrame) -> DataFrame:
    """stats with cond_estimate = sqrt(s1) sqrt(s2), norm_apply_fro = rel_fro * norm_fro, err_solve_fro = rel_solve * sqrt(dim)."""
    return stats.withColumns({"cond_estimate": F.sqrt("s1") * F.sqrt("s2"), "norm_apply_fro": F.col("rel_fro") * F.col("norm_fro"), "err_solve_fro": F.col("rel_solve") * F.sqrt("dim")})


def power_iteration(a: DataFrame | StoredMatrix | TiledMatrix, start: DataFrame, steps: int = 50, normal: bool = True) -> DataFrame:
    """step and lam: |<x, B x>| at each step for B = A* A (or A), x scaled to unit norm; sqrt(lam) tends to the 2-norm.

    start is one vector. The matrix is stored as tiles (see TiledMatrix), unless it is stored already, and each step's
    vector is a table in the shared folder. A step is one job: it shuffles vectors only, keeps x beside B x in the sum
    and hands back three numbers with the table it writes. A zero start or image gives 0.
    """
    spark = start.sparkSession
    scratch, found = Scratch(spark, "power"), []
    stored = a if isinstance(a, StoredMatrix | TiledMatrix) else TiledMatrix(a)
    x = scratch.table(start.groupBy("vec", "idx").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), "x-start")
    sizes = norms(x).limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("power iteration starts from one vector")
    size, last = sizes[0]["norm"] if sizes else 0.0, "x-start"
    for k in range(steps):
        if not size:
            found.append((k, 0.0))
            break
        unit = x.withColumns({c: F.col(c) / size for c in ("re", "im")})
        image = stored.products(apply_matrix(stored, unit), "adjoint") if normal else stored.products(unit)
        none = F.lit(0.0)
        both = image.select("vec", "idx", "re", "im", none.alias("x_re"), none.alias("x_im")).unionByName(unit.select("vec", "idx", none.alias("re"), none.alias("im"), F.col("re").alias("x_re"), F.col("im").alias("x_im")))
        sums = both.groupBy("vec", "idx").agg(*(F.sum(c).alias(c) for c in ("re", "im", "x_re", "x_im")))
        told = Observation()  # of the job's last stage, whose tasks count once
        sums = sums.observe(told, F.expr("sum(x_re * re + x_im * im)").alias("p"), F.expr("sum(x_re * im - x_im * re)").alias("q"), F.expr("sqrt(sum(re * re + im * im))").alias("size"))
        x = scratch.table(sums, f"x{k}").select("vec", "idx", "re", "im")
        got = told.get
        found.append((k, ((got["p"] or 0.0) ** 2 + (got["q"] or 0.0) ** 2) ** 0.5))
        scratch.drop(last)
        size, last = got["size"], f"x{k}"
    scratch.drop(last)
    if stored is not a:
        stored.drop()
    return spark.createDataFrame(found, "step int, lam double")
