"""Grids, points, directions, meshes and vectors made by Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.draws import normal, uniform


def sweep(sizes: DataFrame, pairs: DataFrame, threads: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Every combination of four small tables, with a JSON text of each as `config`.

    Sizes have kappa, h or both: kappa alone gives h = 2 pi / (8 kappa), h alone kappa 0. Pairs have level and depth;
    a row with a level and a size is an error.
    """
    both = sizes.crossJoin(pairs).crossJoin(threads).crossJoin(tolerances)
    clash = F.col("level").isNotNull() & (F.col("kappa").isNotNull() | F.col("h").isNotNull())
    h = F.when(clash, F.raise_error(F.lit("a mesh size and a refinement level at once")).cast("double")).otherwise(F.coalesce("h", 2 * math.pi / (8 * F.col("kappa"))))
    out = both.withColumn("h", h).withColumn("kappa", F.coalesce("kappa", F.lit(0.0)))
    return out.withColumn("config", F.to_json(F.struct(*out.columns)))


def regular_grid(spark: SparkSession, n: int, ndim: int) -> DataFrame:
    """id, x, y, z of the (n + 1)^ndim points k / n, last axis fastest; z is 0 in the plane."""
    m = n + 1
    at = [F.pmod(F.expr(f"id div {m ** (ndim - 1 - a)}"), F.lit(m)) / n for a in range(ndim)] + [F.lit(0.0)] * (3 - ndim)
    return spark.range(m**ndim).select("id", *(c.cast("double").alias(k) for c, k in zip(at, "xyz", strict=True)))


def cells_for(h: float) -> int:
    """Cells an axis for mesh width h: the nearest number, four at least."""
    return max(4, round(1 / h))


def directions(ids: DataFrame, n: int) -> DataFrame:
    """id, x, y, z of n unit vectors on a golden-angle spiral; a single one points along x. ids has ids from 0."""
    if n <= 1:
        return ids.where("id = 0").select("id", F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    z = 1 - 2 * F.col("id") / (n - 1)
    turn = F.col("id") * (math.pi * (3 - math.sqrt(5)))
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return ids.where(F.col("id") < n).select("id", (ring * F.cos(turn)).alias("x"), (ring * F.sin(turn)).alias("y"), z.alias("z"))


def sources_around(points: DataFrame, ids: DataFrame, n: int, padding: float) -> DataFrame:
    """n sources on the sphere about the mean point, padding times as far as the farthest point."""
    centre = points.agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))
    far = points.crossJoin(F.broadcast(centre)).agg(F.max(F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0)))).alias("far"))
    around = directions(ids, n).crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(far))
    return around.select("id", *((F.col(f"c{c}") + padding * F.col("far") * F.col(c)).alias(c) for c in "xyz"))


def square_points(spark: SparkSession, level: int, total: int, seed: int = 42, z: float = 1e-6) -> DataFrame:
    """total points on the unit square, as many in each of 4^level cells; the first cells get one more."""
    side, cells = 2**level, 4**level
    if total < cells:
        raise ValueError("fewer points than cells")
    each, more = divmod(total, cells)
    own = spark.range(cells).select(F.col("id").alias("cell"), F.explode(F.sequence(F.lit(1), F.lit(each) + (F.col("id") < more).cast("int"))).alias("k"))
    u, v = (uniform(seed, F.col("cell"), F.col("k"), t) for t in "xy")
    return own.select("cell", "k", ((F.col("cell") % side + u) / side).alias("x"), ((F.expr(f"cell div {side}") + v) / side).alias("y"), F.lit(z).alias("z"))


def sphere_points(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Uniform on the unit sphere, by the inverse distribution of the height."""
    u, v = (uniform(seed, F.lit(0), F.col("id"), t) for t in "uv")
    z = 1 - 2 * u
    ring = F.sqrt(1 - z * z)
    return ids.select("id", (ring * F.cos(2 * math.pi * v)).alias("x"), (ring * F.sin(2 * math.pi * v)).alias("y"), z.alias("z"))


def box_sphere_points(points: DataFrame) -> DataFrame:
    """points moved along the ray from their bounding box's centre to unit distance; a point in the centre stays."""
    box = points.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"))
    off = points.crossJoin(F.broadcast(box)).select("id", *((F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyz"))
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return off.select("id", *(F.coalesce(F.try_divide(F.col(c), r), F.lit(0.0)).alias(c) for c in "xyz"))


def ball_points(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Uniform in the unit ball: sphere points times the cube root of a draw."""
    r = F.pow(uniform(seed, F.lit(0), F.col("id"), "r"), F.lit(1 / 3))
    return sphere_points(ids, seed).select("id", *((r * F.col(c)).alias(c) for c in "xyz"))


def cube_points(ids: DataFrame, seed: int = 42) -> DataFrame:
    return ids.select("id", *(uniform(seed, F.lit(0), F.col("id"), c).alias(c) for c in "xyz"))


def cube_surface_points(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Cube points over their largest signed coordinate."""
    top = F.greatest("x", "y", "z")
    return cube_points(ids, seed).select("id", *((F.col(c) / top).alias(c) for c in "xyz"))


def trefoil_points(ids: DataFrame, n: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """n points on the trefoil knot, with normal noise on each coordinate if any."""
    t = F.col("id") * (2 * math.pi / n)
    exact = {"x": F.sin(t) + 2 * F.sin(2 * t), "y": F.cos(t) - 2 * F.cos(2 * t), "z": -F.sin(3 * t)}
    return ids.where(F.col("id") < n).select("id", *((v + noise * normal(seed, F.lit(0), F.col("id"), c) if noise else v).alias(c) for c, v in exact.items()))


PLANES = {"xy": ("x", "y", "z"), "xz": ("x", "z", "y"), "yz": ("y", "z", "x")}


def plane_grid(spark: SparkSession, plane: str, n: int, m: int, low: float, high: float, value: float) -> DataFrame:
    """id (second axis fastest), x, y, z of n x m samples of a plane, end points included."""
    a, b, fixed = PLANES[plane]
    step = high - low
    u, v = low + F.expr(f"id div {m}") * (step / (n - 1)), low + F.pmod("id", F.lit(m)) * (step / (m - 1))
    return spark.range(n * m).select("id", *(c.alias(k) for k, c in sorted({a: u, b: v, fixed: F.lit(value)}.items())))


def ring(ids: DataFrame, n: int) -> DataFrame:
    """n angles from 0 to 2 pi, both included, and their unit vectors in the plane."""
    t = F.col("id") * (2 * math.pi / (n - 1))
    return ids.where(F.col("id") < n).select("id", t.alias("angle"), F.cos(t).alias("x"), F.sin(t).alias("y"))


def grid_triangles(spark: SparkSession, n: int) -> DataFrame:
    """eid, a, b, c: two triangles for each cell of an n x n grid of vertices j * n + i."""
    i, j = F.pmod("id", F.lit(n - 1)), F.expr(f"id div {n - 1}")
    v = j * n + i
    pair = F.array(F.struct((2 * F.col("id")).alias("eid"), v.alias("a"), (v + 1).alias("b"), (v + n).alias("c")), F.struct((2 * F.col("id") + 1).alias("eid"), (v + 1).alias("a"), (v + n + 1).alias("b"), (v + n).alias("c")))
    return spark.range((n - 1) ** 2).select(F.explode(pair).alias("t")).select("t.eid", "t.a", "t.b", "t.c")


def gaussian_vectors(ids: DataFrame, samples: int, seed: int = 42, complex_values: bool = False) -> DataFrame:
    """sample, idx, re, im: standard normal vectors over ids, the same under any partitioning."""
    own = ids.select(F.col("id").alias("idx")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    im = normal(seed, F.col("sample"), F.col("idx"), "i") if complex_values else F.lit(0.0)
    return own.select("sample", "idx", normal(seed, F.col("sample"), F.col("idx")).alias("re"), im.alias("im"))


def test_value(idx: Column, offset: float) -> Column:
    t = idx + 1 + offset
    return F.sin(0.29 * t) + 0.25 * F.cos(0.11 * t)


def test_vector(ids: DataFrame, offset: float = 0.0, vec: int = 0) -> DataFrame:
    """vec, idx, re, im: sin(.29 t) + .25 cos(.11 t) with t = idx + 1 + offset."""
    return ids.select(F.lit(vec).alias("vec"), F.col("id").alias("idx"), test_value(F.col("id"), offset).alias("re"), F.lit(0.0).alias("im"))


def complex_test_vector(ids: DataFrame, offset: float = 0.0, vec: int = 0) -> DataFrame:
    """vec, idx, re, im: sin(.31 t) + .2 cos(.13 t), cos(.17 t) with t = idx + 1 + offset."""
    t = F.col("id") + 1 + offset
    return ids.select(F.lit(vec).alias("vec"), F.col("id").alias("idx"), (F.sin(0.31 * t) + 0.2 * F.cos(0.13 * t)).alias("re"), F.cos(0.17 * t).alias("im"))


def unit_vectors(ids: DataFrame) -> DataFrame:
    """vec, idx, re, im: the basis vector of each id, its one alone."""
    return ids.select(F.col("id").alias("vec"), F.col("id").alias("idx"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
