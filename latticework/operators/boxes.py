"""Octree boxes of points: keys, leaves, neighbours, sample rules and colours."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import Scratch, ship


def _interleaved(level: int) -> Column:
    bits = [F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(F.lit(1)), 3 * b + a) for b in range(level) for a, c in enumerate(("ix", "iy", "iz"))]
    return reduce(lambda p, q: p.bitwiseOR(q), bits, F.lit(0).cast("long"))


def finest_boxes(points: DataFrame, depth: int) -> DataFrame:
    """id, key, ix, iy, iz of the box of each point at level `depth` (20 at most); keys interleave the bits of the indices, so that the box of a level above has the key shifted right by 3 bits a level.

    The root is the cube on the lowest corner whose side is the longest side of the bounding box.
    """
    if not 0 <= depth <= 20:
        raise ValueError(f"keys of {depth} levels don't fit 63 bits")
    box = points.agg(*(F.min(c).alias(f"l{c}") for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("side"))
    side = F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)
    cells = 1 << depth
    index = [F.least(F.floor((F.col(c) - F.col(f"l{c}")) / side * F.lit(cells)).cast("long"), F.lit(cells - 1)).alias(f"i{c}") for c in "xyz"]
    return points.crossJoin(F.broadcast(box)).select("id", *index).select("id", _interleaved(depth).alias("key"), "ix", "iy", "iz")


def box_counts(fine: DataFrame, depth: int) -> DataFrame:
    """level, key, ix, iy, iz, n of the boxes of levels 0 to depth that have points, rolled up from the counts of the finest."""
    counts = fine.groupBy("key", "ix", "iy", "iz").agg(F.count("*").alias("n"))
    up = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = lambda c, k: F.expr(f"shiftright({c}, {k} * ({depth} - level))").alias(c)
    return up.groupBy("level", shift("key", 3), *(shift(c, 1) for c in ("ix", "iy", "iz"))).agg(F.sum("n").alias("n"))


def leaf_boxes(counts: DataFrame, most: int, depth: int) -> DataFrame:
    """level, key, n, first and last of the leaves: the coarsest boxes of at most `most` points, or boxes of level depth.

    first to last are the keys at level depth that a leaf has; they don't overlap. A box looks at the one above only.
    """
    above = counts.select((F.col("level") + 1).alias("level"), F.col("key").alias("up"), F.col("n").alias("n_up"))
    own = counts.withColumn("up", F.shiftright("key", 3)).join(above, ["level", "up"], "left")
    own = own.where((F.col("level") == 0) | (F.col("n_up") > most)).where((F.col("n") <= most) | (F.col("level") == depth))
    return own.select("level", "key", "n", F.expr(f"shiftleft(key, 3 * ({depth} - level))").alias("first"), F.expr(f"shiftleft(key + 1, 3 * ({depth} - level)) - 1").alias("last"))


def _carried(batches):
    """Rows in the order of key, leaves before points, with the leaf that came last; part numbers tell where none came yet."""
    part, level, key = TaskContext.get().partitionId(), -1, -1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, levels, keys = (batch.column(c) for c in ("id", "leaf_level", "leaf_key"))
        mark = np.asarray(levels.is_valid())
        at = np.maximum.accumulate(np.where(mark, np.arange(n), -1))
        known, last = at >= 0, np.maximum(at, 0)
        out_level = np.where(known, np.asarray(levels.fill_null(-1))[last], level).astype(np.int32)
        out_key = np.where(known, np.asarray(keys.fill_null(-1))[last], key)
        level, key = int(out_level[-1]), int(out_key[-1])
        yield pa.RecordBatch.from_arrays([ids, pa.array(mark), pa.array(out_level), pa.array(out_key), pa.array(np.full(n, part, np.int32))], ["id", "mark", "level", "key", "part"])


def leaves(fine: DataFrame, leaf: DataFrame, depth: int) -> DataFrame:
    """id, level, key: the leaf (of leaf_boxes) of each point (of finest_boxes), looked up by range.

    Points and the first keys of leaves are sorted together by ranges, which is the one shuffle of the points, and each
    point takes the last leaf before it. Parts that begin within a leaf take it from the parts before, of which a row
    each is broadcast; so points of one box may lie in several parts.
    """
    spark = fine.sparkSession
    ship(spark)
    scratch, n = Scratch(spark, "leaves"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    marks = leaf.select("first", none.cast("long").alias("id"), F.col("level").cast("int").alias("leaf_level"), F.col("key").alias("leaf_key"))
    both = fine.select(F.col("key").alias("first"), F.col("id").cast("long").alias("id"), none.cast("int").alias("leaf_level"), none.cast("long").alias("leaf_key")).unionByName(marks)
    order = ["first", F.col("leaf_level").isNull(), "id"]
    dealt = both.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "leaf_level", "leaf_key")
    rows = scratch.table(dealt.mapInArrow(_carried, "id long, mark boolean, level int, key long, part int"), "rows")
    ends = rows.where("mark").groupBy("part").agg(F.max_by(F.struct("level", "key"), F.expr(f"shiftleft(key, 3 * ({depth} - level))")).alias("b"))
    parts = rows.select("part").distinct().join(ends, "part", "left").withColumn("before", F.last("b", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    whole = rows.where("not mark").join(F.broadcast(parts.select("part", "before")), "part")  # a row for each part
    return whole.select("id", *(F.when(F.col("level") >= 0, F.col(c)).otherwise(F.col("before")[c]).alias(c) for c in ("level", "key")))


def leaf_summary(leaf: DataFrame) -> DataFrame:
    """n_leaves, max_level, max_points of leaf_boxes."""
    return leaf.agg(F.count("*").alias("n_leaves"), F.max("level").alias("max_level"), F.max("n").alias("max_points"))


def leaf_energy(leaf: DataFrame, x: DataFrame) -> DataFrame:
    """level, key, energy: sum of |v|^2 over the points of each leaf."""
    return leaf.join(x, leaf["id"] == x["idx"]).groupBy("level", "key").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("energy"))


def neighbours(counts: DataFrame) -> DataFrame:
    """level, key, other: boxes with points at the same level that touch a box, itself not among them."""
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    around = counts.select("level", "key", "ix", "iy", "iz").withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("dz", F.explode(step)).where("dx <> 0 or dy <> 0 or dz <> 0")
    asked = around.select("level", "key", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), (F.col("iz") + F.col("dz")).alias("iz"))
    return asked.join(counts.select("level", F.col("key").alias("other"), "ix", "iy", "iz"), ["level", "ix", "iy", "iz"]).select("level", "key", "other")


def active_counts(counts: DataFrame, leaf_level: int, rank: int) -> DataFrame:
    """level, key, ix, iy, iz, act: points in a box at leaf_level; above, the sum over children of min(rank, act)."""
    rows = counts.where(F.col("level") == leaf_level).select("level", "key", "ix", "iy", "iz", F.col("n").alias("act"))
    out = [rows]
    for level in range(leaf_level - 1, -1, -1):
        up = rows.groupBy(F.lit(level).alias("level"), F.shiftright("key", 3).alias("key"), *(F.shiftright(c, 1).alias(c) for c in ("ix", "iy", "iz")))
        rows = up.agg(F.sum(F.least(F.lit(rank), F.col("act"))).cast("long").alias("act"))
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def sample_rule(active: DataFrame, rank: int, extra: int) -> DataFrame:
    """level, key, s: act(B) + act of B's neighbours + min(rank, act(B)) + extra."""
    near = neighbours(active)
    around = near.join(active.select("level", F.col("key").alias("other"), "act"), ["level", "other"]).groupBy("level", "key").agg(F.sum("act").alias("near"))
    own = active.join(around, ["level", "key"], "left")
    return own.select("level", "key", (F.col("act") + F.coalesce("near", F.lit(0)) + F.least(F.lit(rank), F.col("act")) + extra).alias("s"))


def sample_counts(active: DataFrame, rank: int, extra: int) -> DataFrame:
    """s_max (largest s below the root) and s_0 = min(s_max, 2 act(root) + 2 extra)."""
    top = sample_rule(active, rank, extra).where("level > 0").agg(F.max("s").alias("s_max"))
    root = active.where("level = 0").agg(F.max("act").alias("root"))
    return top.crossJoin(root).select("s_max", F.least("s_max", 2 * F.col("root") + 2 * extra).alias("s_0"))


def launched(active: DataFrame, rank: int) -> DataFrame:
    """Boxes with more active points than the rank."""
    return active.where(F.col("act") > rank)


def colours(boxes: DataFrame, near: DataFrame) -> DataFrame:
    """level, key, colour of the boxes, so that boxes of a level whose neighbourhoods (themselves included) overlap differ.

    boxes has level and key, near has level, key and other. In the order of keys each box takes the smallest colour
    that no earlier box in conflict has. A round colours, at all levels, each group of boxes with the same box two
    levels up (64 at most) whose earlier groups in conflict are done; within a group one box after the other.
    """
    box, group = ["level", "key"], F.shiftright("key", 6)
    scratch = Scratch(boxes.sparkSession, "colours")
    own = boxes.select(*box).distinct().withColumn("g", group)
    reach = near.join(own, box, "left_semi").select(*box, "other").unionByName(own.select(*box, F.col("key").alias("other"))).distinct()
    conflicts = reach.alias("a").join(reach.alias("b"), ["level", "other"]).where("a.key > b.key").select("level", F.col("a.key").alias("key"), F.col("b.key").alias("before")).distinct()
    conflicts = scratch.table(conflicts.withColumns({"g": group, "h": F.shiftright("before", 6)}), "conflicts")
    waits = scratch.table(conflicts.where("g > h").select("level", "g", "h").distinct(), "waits")
    left, step, done = scratch.table(own.select("level", "g").distinct(), "left-0"), 0, None
    free = "array_min(filter(sequence(0, size(t)), c -> not array_contains(t, c)))"
    smallest = f"element_at(transform(array(concat(x.taken, transform(x.own, k -> m[k]))), t -> {free}), 1)"
    fold = f"aggregate(array_sort(collect_list(struct(key, taken, own))), cast(map() as map<bigint, int>), (m, x) -> map_concat(m, map(x.key, {smallest})))"
    while not left.isEmpty():
        blocked = waits.join(left.withColumnRenamed("g", "h"), ["level", "h"], "left_semi").select("level", "g").distinct()
        ready = left.join(blocked, ["level", "g"], "left_anti")
        pairs = conflicts.join(ready, ["level", "g"], "left_semi")
        known = pairs.join(done.select("level", F.col("key").alias("before"), "colour"), ["level", "before"], "left") if done is not None else pairs.withColumn("colour", F.lit(None).cast("int"))
        told = known.groupBy(*box).agg(F.collect_set("colour").alias("taken"), F.collect_list(F.when(F.col("g") == F.col("h"), F.col("before"))).alias("own"))
        rows = own.join(ready, ["level", "g"], "left_semi").join(told, box, "left")
        rows = rows.withColumns({"taken": F.coalesce("taken", F.array().cast("array<int>")), "own": F.coalesce("own", F.array().cast("array<bigint>"))})
        new = rows.groupBy("level", "g").agg(F.expr(fold).alias("m")).select("level", F.explode("m").alias("key", "colour"))
        step += 1
        done = scratch.table(new if done is None else done.unionByName(new), f"round-{step}")
        left = scratch.table(left.join(blocked, ["level", "g"], "left_semi"), f"left-{step}")
        scratch.drop(f"left-{step - 1}")
        if step > 1:
            scratch.drop(f"round-{step - 1}")
    return done


def block_index(ids: DataFrame, wide: int = 4096) -> DataFrame:
    """id, block = id div wide."""
    return ids.select("id", F.expr(f"id div {wide}").alias("block"))


def work_chunks(ids: DataFrame, workers: int, wide: int = 65536) -> DataFrame:
    """chunk, first, last: ranges of ceil(n / workers) places in the order of distinct ids.

    A place is the number of ids in earlier ranges of `wide` ids, summed over the ranges' counts, and the rank within
    its own range; so no task has to sort all ids.
    """
    own = ids.select("id", F.expr(f"id div {wide} - if(id < 0, 1, 0)").alias("range"))
    counts = own.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = own.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1).join(before, "range")
    total = counts.agg(F.sum("n").alias("n"))
    chunk = F.expr(f"(before + rank) div cast(ceil(n / {workers}) as long)")
    return place.crossJoin(F.broadcast(total)).select(chunk.alias("chunk"), (F.col("before") + F.col("rank")).alias("place")).groupBy("chunk").agg(F.min("place").alias("first"), F.max("place").alias("last"))
