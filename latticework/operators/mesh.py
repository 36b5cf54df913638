"""Triangle meshes as vertices (vid, x, y, z) and elements (eid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.session import Scratch


def torus(spark: SparkSession, n: int, m: int, copies: int = 1, flip: bool = False, hole: bool = False) -> tuple[DataFrame, DataFrame]:
    """A closed torus of 2 n m triangles, `copies` times far apart; flip turns the first element, hole leaves it out."""
    u, v, c = F.expr(f"(id div {m}) % {n}"), F.expr(f"id % {m}"), F.expr(f"id div {n * m}")
    turn = 2 * 3.141592653589793
    wide = 2 + F.cos(turn * v / m)
    vertices = spark.range(n * m * copies).select(F.col("id").alias("vid"), (wide * F.cos(turn * u / n) + 10 * c).alias("x"), (wide * F.sin(turn * u / n)).alias("y"), F.sin(turn * v / m).alias("z"))
    at = lambda du, dv: c * (n * m) + ((u + du) % n) * m + (v + dv) % m
    two = F.array(F.struct((2 * F.col("id")).alias("eid"), at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("c")), F.struct((2 * F.col("id") + 1).alias("eid"), at(1, 0).alias("a"), at(1, 1).alias("b"), at(0, 1).alias("c")))
    elements = spark.range(n * m * copies).select(F.explode(two).alias("t")).select("t.*")
    if flip:
        elements = elements.select("eid", "a", *(F.when(F.col("eid") == 0, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("b", "c"), ("c", "b"))))
    return vertices, elements.where("eid > 0") if hole else elements


def corners(elements: DataFrame) -> DataFrame:
    """eid, corner (0 to 2), vid."""
    return elements.select("eid", F.posexplode(F.array("a", "b", "c")).alias("corner", "vid"))


def barycentres(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """eid, x, y, z."""
    return corners(elements).join(vertices, "vid").groupBy("eid").agg(*(F.avg(c).alias(c) for c in "xyz"))


def edges(elements: DataFrame) -> DataFrame:
    """eid, p, q, way: the three edges of each element, p < q, way 1 if it runs from p to q and -1 if not."""
    three = F.array(*(F.struct(F.col(s).alias("s"), F.col(e).alias("e")) for s, e in (("a", "b"), ("b", "c"), ("c", "a"))))
    own = elements.select("eid", F.explode(three).alias("d"))
    return own.select("eid", F.least("d.s", "d.e").alias("p"), F.greatest("d.s", "d.e").alias("q"), F.when(F.col("d.s") < F.col("d.e"), 1).otherwise(-1).alias("way"))


def edge_midpoints(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """p, q, x, y, z."""
    ends = edges(elements).select("p", "q").distinct().withColumn("vid", F.explode(F.array("p", "q")))
    return ends.join(vertices, "vid").groupBy("p", "q").agg(*(F.avg(c).alias(c) for c in "xyz"))


def vertex_means(elements: DataFrame, values: DataFrame) -> DataFrame:
    """eid, value: mean over an element's corners of values (vid, value)."""
    return corners(elements).join(values, "vid").groupBy("eid").agg(F.avg("value").alias("value"))


def with_corners(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """eid and the coordinates ax to cz of each element."""
    out = elements
    for k in "abc":
        out = out.join(vertices.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in "xyz")), k)
    return out.select("eid", *(k + c for k in "abc" for c in "xyz"))


def manifold_report(vertices: DataFrame, elements: DataFrame) -> DataFrame:
    """n_boundary, n_nonmanifold, n_same_way edges, signed volume, and closed: none of these and a positive volume."""
    each = edges(elements).groupBy("p", "q").agg(F.count("*").alias("n"), F.sum("way").alias("way"))
    counts = each.agg(*(F.coalesce(F.sum(F.expr(f"cast({rule} as long)")), F.lit(0)).alias(name) for name, rule in (("n_boundary", "n = 1"), ("n_nonmanifold", "n > 2"), ("n_same_way", "n = 2 and way <> 0"))))
    six = F.expr("ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)")
    volume = with_corners(vertices, elements).agg((F.sum(six) / 6).alias("volume"))
    return counts.crossJoin(volume).withColumn("closed", F.expr("n_boundary = 0 and n_nonmanifold = 0 and n_same_way = 0 and volume > 0"))


def mesh_components(elements: DataFrame, least: int = 50) -> DataFrame:
    """eid, component (the smallest element reachable over shared edges), of components of `least` elements or more.

    Every element takes the smallest label at its edges, and then that label's own label, until none changes. Labels are
    shuffled, never broadcast, so that no step sends them to the driver.
    """
    scratch = Scratch(elements.sparkSession, "mesh")
    own = scratch.table(edges(elements).select("eid", "p", "q"), "edges")
    label, before, step = own.select("eid", F.col("eid").alias("component")).distinct(), None, 0
    while True:
        at_edge = own.join(label.hint("merge"), "eid").groupBy("p", "q").agg(F.min("component").alias("component"))
        lower = own.join(at_edge.hint("merge"), ["p", "q"]).groupBy("eid").agg(F.min("component").alias("component"))
        jump = lower.select(F.col("eid").alias("component"), F.col("component").alias("next"))
        label = scratch.table(lower.join(jump.hint("merge"), "component").select("eid", F.col("next").alias("component")), f"label-{step}")
        now = label.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if step:
            scratch.drop(f"label-{step - 1}")
        if now == before:
            break
        before, step = now, step + 1
    big = label.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return label.join(big.select("component").hint("merge"), "component", "left_semi").select("eid", "component")


def _clipped(polygon: str, c: str, at: float, sign: str) -> str:
    """SQL: the part of a polygon (array of structs x, y, z) with sign * (c - at) >= 0: its corners there, and where its edges cross the plane."""
    dp, dq = f"(p.{c} - {at}D)", f"(q.{c} - {at}D)"
    point = ", ".join(f"'{k}', p.{k} + {dp} / ({dp} - {dq}) * (q.{k} - p.{k})" for k in "xyz")
    none = "cast(array() as array<struct<x: double, y: double, z: double>>)"
    edges = f"zip_with({polygon}, concat(slice({polygon}, 2, size({polygon}) - 1), slice({polygon}, 1, 1)), (p, q) -> concat(if({sign} * {dp} >= 0, array(p), {none}), if({dp} * {dq} < 0, array(named_struct({point})), {none})))"
    return f"if(size({polygon}) < 3, {none}, flatten({edges}))"


def quadrant_clip(vertices: DataFrame, elements: DataFrame, y: float, z: float) -> DataFrame:
    """eid, quadrant, part and corners ax to cz: elements cut at the planes of y and z, each piece as a fan of triangles.

    Both sides of a plane are closed, and the cut is left open. Quadrants: 0 both above, 1 y below, 2 both below, 3 z below.
    """
    own = with_corners(vertices, elements)
    corner = lambda k: f"named_struct('x', {k}x, 'y', `{k}y`, 'z', {k}z)"
    signs = "array(struct(0, 1, 1), struct(1, -1, 1), struct(2, -1, -1), struct(3, 1, -1))"
    each = own.select("eid", F.expr(f"array({', '.join(corner(k) for k in 'abc')})").alias("whole"), F.explode(F.expr(signs)).alias("s"))
    half = each.select("eid", "s", F.expr(_clipped("whole", "y", float(y), "s.col2")).alias("half"))
    cut = half.select("eid", F.col("s.col1").alias("quadrant"), F.expr(_clipped("half", "z", float(z), "s.col3")).alias("cut")).where("size(cut) >= 3")
    fan = cut.select("eid", "quadrant", "cut", F.posexplode(F.expr("sequence(1, size(cut) - 2)")).alias("part", "k"))
    names = [(f"{n}{c}", f"{at}.{c}") for n, at in (("a", "cut[0]"), ("b", "cut[k]"), ("c", "cut[k + 1]")) for c in "xyz"]
    return fan.select("eid", "quadrant", "part", *(F.expr(e).alias(n) for n, e in names))


def area(pieces: DataFrame) -> DataFrame:
    """pieces with area, from corners ax to cz."""
    p, q, r = "(by - ay) * (cz - az) - (bz - az) * (cy - ay)", "(bz - az) * (cx - ax) - (bx - ax) * (cz - az)", "(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)"
    return pieces.withColumn("area", F.expr(f"0.5 * sqrt(power({p}, 2) + power({q}, 2) + power({r}, 2))"))
