"""All pairs of vectors of a least cosine: an epsilon grid order join.

Unit vectors are sorted by the cells of a grid, as wide as the distance of the least cosine, on their leading principal
directions, and cut into tiles of bounded bytes. Pairs of intervals of tiles are split again and again, and those whose
boxes are provably distant are skipped; pairs of tiles that remain do the same with their chunks in a task, down to
matrix products. Where two balls lie provably within the distance, all their pairs are links without a product. Tasks
return sums of links and a forest of each pair of tiles, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import tidied
from latticework.llm.components import components
from latticework.session import Scratch, ship

#: Bytes of a tile's vectors, rows of a chunk, tiles or intervals of an interval.
TILE_BYTES, CHUNK, FAN = 4 << 20, 256, 8
#: What rounding may add to a distance, and how near the least cosine a product is taken again from the vectors themselves.
SLACK, CLOSE = 1e-9, 1e-9


def scaled(v: np.ndarray) -> np.ndarray:
    """v with each row divided by a power of two, so that squares neither overflow nor vanish."""
    return v / np.exp2(np.floor(np.log2(np.abs(v).max(1, keepdims=True, initial=1e-300))))


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def directions(sample: np.ndarray, most: int) -> np.ndarray:
    """The leading principal directions of unit vectors, as columns; any orthonormal ones give right results."""
    _, vectors = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1) if len(sample) > 1 else np.eye(sample.shape[1]))
    return vectors[:, ::-1][:, :most]


class Chunks:
    """Chunks of a tile, in order: their boxes on the directions, centres and radii."""

    def __init__(self, v: np.ndarray, basis: np.ndarray):
        self.v, self.u = v, units(v)
        self.cut = [*range(0, len(v), CHUNK), len(v)]
        p = self.u @ basis
        pairs = list(zip(self.cut[:-1], self.cut[1:], strict=True))
        self.low, self.high = np.array([p[a:b].min(0) for a, b in pairs]), np.array([p[a:b].max(0) for a, b in pairs])
        self.centre = np.array([self.u[a:b].mean(0) for a, b in pairs])
        self.radius = np.array([np.sqrt(((self.u[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(pairs, self.centre, strict=True)])


def tile_links(a: Chunks, b: Chunks, weight_a: np.ndarray, weight_b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the rows linked with each row of a and of b, and for all rows (b's behind a's) the least row that links lead to. same: a and b are one tile."""
    reach = math.sqrt(2 - 2 * least)
    n, links = len(a.v), [np.zeros(len(a.v), np.int64), np.zeros(len(b.v), np.int64)]
    root = np.arange(n if same else n + len(b.v))
    shift = 0 if same else n

    def unite(i, j):
        while True:
            x, y = root[i], root[j]
            if (x == y).all():
                return
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]

    def leaf(x, y):
        (p, q), (r, s) = (a.cut[x], a.cut[x + 1]), (b.cut[y], b.cut[y + 1])
        if np.sqrt(((a.centre[x] - b.centre[y]) ** 2).sum()) + a.radius[x] + b.radius[y] <= reach - SLACK:
            near = np.ones((q - p, s - r), bool)
        else:
            cosine = a.u[p:q] @ b.u[r:s].T
            near = cosine >= least
            i, j = np.nonzero(np.abs(cosine - least) < CLOSE)
            if len(i):
                f, g = scaled(a.v[p:q][i]), scaled(b.v[r:s][j])
                near[i, j] = (f * g).sum(1) / (np.sqrt((f * f).sum(1)) * np.sqrt((g * g).sum(1))) >= least
        alone = same and x == y
        if alone:
            np.fill_diagonal(near, False)
        if near.any():
            links[0][p:q] += near @ weight_b[r:s]
            if not alone:
                links[0 if same else 1][r:s] += near.T @ weight_a[p:q]
            i, j = np.nonzero(near)
            unite(i + p, j + r + shift)

    def join(x0, x1, y0, y1):
        gap = np.maximum(0, np.maximum(b.low[y0:y1].min(0) - a.high[x0:x1].max(0), a.low[x0:x1].min(0) - b.high[y0:y1].max(0)))
        if (gap * gap).sum() > (reach + SLACK) ** 2 or same and y1 <= x0:
            return
        if x1 - x0 == 1 and y1 - y0 == 1:
            leaf(x0, y0)
        elif x1 - x0 >= y1 - y0:
            middle = (x0 + x1) // 2
            join(x0, middle, y0, y1)
            join(middle, x1, y0, y1)
        else:
            middle = (y0 + y1) // 2
            join(x0, x1, y0, middle)
            join(x0, x1, middle, y1)

    if len(a.v) and len(b.v):
        join(0, len(a.cut) - 1, 0, len(b.cut) - 1)
    return *links, root


def tile_pairs(tiles: DataFrame, n_tiles: int, reach: float, scratch: Scratch) -> DataFrame:
    """a, b (a <= b) and near of all pairs of tiles (tile, low, high, centre, radius) that are not provably distant; near: all their vectors are within reach."""
    levels = [tiles.select("tile", "low", "high")]
    while n_tiles > FAN:
        n_tiles = -(-n_tiles // FAN)
        by = [F.transform(F.array_agg(c), lambda x: x) for c in ("low", "high")]
        ends = [F.expr(f"transform(sequence(0, size(x[0]) - 1), k -> array_{f}(transform(x, y -> y[k])))") for f in ("min", "max")]
        grouped = levels[-1].groupBy(F.floor(F.col("tile") / FAN).alias("tile")).agg(*(b.alias(c) for b, c in zip(by, ("lows", "highs"), strict=True)))  # FAN rows each
        step = grouped.withColumn("x", F.col("lows")).withColumn("low", ends[0]).withColumn("x", F.col("highs")).withColumn("high", ends[1])
        levels.append(scratch.table(step.select("tile", "low", "high"), f"level-{len(levels)}"))
    distance = "aggregate(zip_with(zip_with(l.low, r.high, (p, q) -> p - q), zip_with(r.low, l.high, (p, q) -> p - q), (p, q) -> greatest(p, q, double(0))), double(0), (s, x) -> s + x * x)"
    close = F.expr(f"{distance} <= {(reach + SLACK) ** 2!r}")
    pairs = None
    for level, boxes in enumerate(reversed(levels)):
        if pairs is None:  # FAN intervals at most
            made = boxes.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", F.lit(n_tiles - 1))).alias("b"))
        else:
            part = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
            made = pairs.select(part("a"), "b").select("a", part("b")).where("a <= b")
        own = made.join(boxes.alias("l"), F.col("a") == F.col("l.tile")).join(boxes.alias("r"), F.col("b") == F.col("r.tile"))
        pairs = scratch.table(own.where(close).select("a", "b"), f"pairs-{level}")
    between = "sqrt(aggregate(zip_with(l.centre, r.centre, (p, q) -> p - q), double(0), (s, x) -> s + x * x))"
    ball = tiles.select("tile", "centre", "radius")
    own = pairs.join(ball.alias("l"), F.col("a") == F.col("l.tile")).join(ball.alias("r"), F.col("b") == F.col("r.tile"))
    return own.select("a", "b", F.expr(f"{between} + l.radius + r.radius <= {reach - SLACK!r}").alias("near"))


def class_links(classes: DataFrame, wide: int, least: float, n_directions: int, most_trained: int, tile_bytes: int, scratch: Scratch) -> DataFrame:
    """h1, h2, n_links and component (the least id) of each class (h1, h2, least_id, weight, v), all of `wide` numbers."""
    spark, reach = classes.sparkSession, math.sqrt(2 - 2 * least)
    sample = classes.orderBy("h1", "h2").limit(max(2, min(most_trained, (8 << 20) // (8 * wide)))).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return None
    basis = directions(units(np.array(sample, float)), min(n_directions, wide))
    width, schema = max(reach, 1e-6), "h1 long, h2 long, least_id long, weight long, v array<double>, cells array<int>"

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(units(np.asarray(batch.column("v").flatten()).reshape(-1, wide)) @ basis / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], [x.split()[0] for x in schema.split(", ")])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cells", "h1", "h2"]
    placed = classes.mapInArrow(tidied(place), schema).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = scratch.table(placed.drop("cells").withColumn("mid", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("mid", 33)), f"order-{wide}")
    parts = rows.groupBy("pid").agg(F.min("mid").alias("first"), F.count("*").alias("n"))  # a row for each part of the range sort
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tile_rows = max(CHUNK, tile_bytes // (8 * wide))
    rows = rows.join(F.broadcast(parts.select("pid", (F.col("before") - F.col("first")).alias("shift"))), "pid").withColumn("node", F.col("mid") + F.col("shift"))
    rows = scratch.table(rows.select("node", F.floor(F.col("node") / tile_rows).alias("tile"), "h1", "h2", "least_id", "weight", "v"), f"tiles-{wide}")

    def describe(key, table):
        u = units(np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, wide))
        p, centre = u @ basis, u.mean(0)
        return pa.table({"tile": [key[0].as_py()], "low": [p.min(0).tolist()], "high": [p.max(0).tolist()], "centre": [centre.tolist()], "radius": [float(np.sqrt(((u - centre) ** 2).sum(1).max()))], "weight": [int(np.asarray(table.column("weight")).sum())], "first": [int(np.asarray(table.column("node")).min())]})

    tiles = scratch.table(rows.select("tile", "node", "weight", "v").groupBy("tile").applyInArrow(describe, "tile long, low array<double>, high array<double>, centre array<double>, radius double, weight long, first long"), f"boxes-{wide}")
    pairs = scratch.table(tile_pairs(tiles, tiles.count(), reach, Scratch(spark, "intervals")), f"pairs-{wide}")

    # pairs of tiles to be compared: each tile's rows go to its pairs
    far = pairs.where("not near").select("a", "b")
    sides = far.select("a", "b", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(far.where("a <> b").select("a", "b", F.col("b").alias("tile"), F.lit(1).alias("side")))
    sent = sides.join(rows.select("tile", "node", "weight", "v"), "tile").select("a", "b", "side", "node", "weight", "v")

    def compare(key, table):
        table = table.combine_chunks()
        side, node, weight = (np.asarray(table.column(c)) for c in ("side", "node", "weight"))
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, wide)
        order = np.lexsort((node, side))
        side, node, weight, v = side[order], node[order], weight[order], v[order]
        n_a, same = int((side == 0).sum()), key[0].as_py() == key[1].as_py()
        one = Chunks(v[:n_a], basis)
        two = one if same else Chunks(v[n_a:], basis)
        x, y, root = tile_links(one, two, weight[:n_a], weight[:n_a] if same else weight[n_a:], least, same)
        links = x if same else np.concatenate([x, y])
        told = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.table({"node": node[told], "other": node[root[told]], "n": links[told]})

    links = sent.groupBy("a", "b").applyInArrow(compare, "node long, other long, n long")
    # of tiles within reach as a whole, each row links with all of the other, and the first stands for them
    whole = pairs.where("near").select("a", "b")
    whole = whole.unionByName(whole.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).join(tiles.select(F.col("tile").alias("b"), "weight", "first"), "b")
    whole = whole.groupBy(F.col("a").alias("tile")).agg(F.sum("weight").alias("n"), F.min("first").alias("other"), F.max((F.col("a") == F.col("b")).cast("int")).alias("own"))
    near = rows.select("tile", "node", "weight").join(whole, "tile").select("node", "other", (F.col("n") - F.col("own") * F.col("weight")).alias("n"))
    firsts = pairs.where("near and a <> b").join(tiles.select(F.col("tile").alias("a"), F.col("first").alias("node")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("first").alias("other")), "b").select("node", "other", F.lit(0).cast("long").alias("n"))
    links = scratch.table(links.unionByName(near).unionByName(firsts), f"links-{wide}")
    sums = links.groupBy("node").agg(F.sum("n").alias("n"))
    members = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b"), scratch, f"component-{wide}")
    of = rows.select("node", "h1", "h2", "least_id", "weight").join(sums, "node", "left").join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = scratch.table(of, f"of-{wide}")
    least_ids = of.groupBy("component").agg(F.min("least_id").alias("least"))
    return of.join(least_ids, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("least").alias("component_id"))


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", n_directions: int = 16, most_trained: int = 4096, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links (other vectors of a cosine of `least` or more), component_id (the smallest id reachable by links) and kept (vec_id is that id), a row a vector.

    0 < least <= 1. Equal vectors are compared as one and counted as many. The directions are learnt from at most
    most_trained vectors and 8 MB of them; they decide what is skipped, never the result. Vectors that are null, empty
    or all zero, or hold null or non-finite numbers, and rows without id link with nothing, as do vectors of unlike
    length; lengths are taken one after another. Rows with a repeated id are vectors of their own. An empty table gives
    an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "grid-join")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("v", F.expr(f"if({usable}, v, null)")).withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = scratch.table(classes, "classes")
    found = None
    for (wide,) in sorted(classes.select(F.size("v")).distinct().collect()):
        own = class_links(classes.where(F.size("v") == wide), wide, least, n_directions, most_trained, tile_bytes, scratch)
        found = own if found is None else found.unionByName(own)
    rows = rows.drop("v")
    if found is None:
        found = rows.select("h1", "h2", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).limit(0)
    out = rows.join(found, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
