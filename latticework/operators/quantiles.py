"""Exact quantiles by keys, by counting in ranges: no task holds the values of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import Scratch

#: Values of a range that is sorted as it is, at most.
MOST = 1 << 20
#: How far from a wanted share of the rows the first cuts lie, and the parts into which later ranges are cut.
ASIDE, PARTS = 1e-3, 32
#: Wanted ranks of which tables (of ranges and cuts, a row or so for each) are broadcast, at most.
SMALL = 4096


def _bin(value: Column, cuts: Column) -> Column:
    """2 k below the (k + 1)-th of the sorted cuts, 2 k + 1 at it."""
    return F.aggregate(cuts, F.lit(0), lambda k, c: k + F.when(c < value, 2).when(c == value, 1).otherwise(0))


def ranked(rows: DataFrame, wanted: DataFrame, scratch: Scratch, first_cuts: list[float], most: int, longest: int, few: bool) -> DataFrame:
    """g, rank, v: the value of rank `rank` (from 0, equal values one after another) among the rows (g, v) of g, for each row of wanted (g, rank, n: rows of g).

    A range is a run of a group's sorted values: `below` rows lie below it, n are in it. Ranges with wanted ranks are cut
    at approximate quantiles and counted, all groups in one job, and only rows of ranges that hold a wanted rank go on;
    values equal to a cut are a range of their own, which needs no sorting. Ranges of `most` rows are sorted. longest: rows
    of the largest group; few: wanted has SMALL rows at most.
    """
    key, found, step, _sent = ["g", "below"], [], 0, F.broadcast if few else lambda df: df
    ranges = wanted.select("g", F.lit(0).cast("long").alias("below"), "n").distinct()
    rows = rows.withColumn("below", F.lit(0).cast("long"))
    shares = sorted({min(max(p + d, 0.0), 1.0) for p in first_cuts for d in (-ASIDE, 0.0, ASIDE)})
    inside = F.expr("rank >= below and rank < below + n")
    while True:
        ranges = scratch.table(ranges, f"ranges-{step}") if step else ranges
        short = ranges.where(F.col("n") <= most)
        own = rows.join(_sent(short.select(*key)), key).withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy(*key).orderBy("v")) - 1)
        found.append(own.join(_sent(wanted.select("g", "rank")), ["g", "rank"]).select("g", "rank", "v"))
        long = ranges.where(F.col("n") > most)
        if longest <= most or (step and long.isEmpty()):
            return reduce(DataFrame.unionByName, found)
        own = rows.join(_sent(long.select(*key)), key)
        cuts = own.groupBy(*key).agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), 10000).alias("cuts"))
        cuts = scratch.table(cuts.withColumn("cuts", F.array_sort(F.array_distinct("cuts"))), f"cuts-{step}")
        binned = own.join(_sent(cuts), key).withColumn("bin", _bin(F.col("v"), F.col("cuts")))
        counts = scratch.table(binned.groupBy(*key, "bin").agg(F.count("*").alias("n")), f"counts-{step}")
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("bin")) - F.col("n")  # a row for each bin of a range
        bins = counts.withColumn("from", F.col("below") + upto).join(_sent(cuts), key)
        parts = bins.select("g", F.col("below").alias("old"), "bin", F.col("from").alias("below"), "n", F.when(F.col("bin") % 2 == 1, F.col("cuts")[F.expr("bin div 2")]).alias("v"))
        held = scratch.table(parts.join(_sent(wanted.select("g", "rank")), "g").where(inside), f"held-{step}")
        found.append(held.where("v is not null").select("g", "rank", "v"))
        ranges = held.where("v is null").select("g", "old", "bin", "below", "n").distinct()
        kept = binned.withColumnRenamed("below", "old").join(_sent(ranges.select("g", "old", "bin", "below")), ["g", "old", "bin"])
        step += 1
        rows, ranges = scratch.table(kept.select("g", "below", "v"), f"rows-{step}"), ranges.select("g", "below", "n")
        shares = [k / PARTS for k in range(1, PARTS)]


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], most: int = MOST) -> DataFrame:
    """keys and q, an array: the quantiles of value at the given shares, interpolated between neighbours, by keys.

    Nulls and NaN take no part, and -0 counts as 0; keys without other values are left out, and null keys are a group of their own. Without
    keys one row comes back, or none for no values. df is read two or three times.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("k"))
    rows = df.select(group.alias("g"), (F.col(value).cast("double") + F.lit(0.0)).alias("v")).where("v is not null and not isnan(v)")
    sizes = scratch.table(rows.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    asked = sizes.select("g", "n", F.posexplode(F.array(*map(F.lit, shares))).alias("k", "share")).withColumn("place", F.col("share") * (F.col("n") - 1))
    asked = asked.select("g", "n", "k", F.floor("place").alias("low"), F.ceil("place").alias("high"), (F.col("place") - F.floor("place")).alias("part"))
    wanted = asked.select("g", "n", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")).distinct()
    size = sizes.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    found = scratch.table(ranked(rows, wanted, scratch, shares, most, size["n"] or 0, size["k"] * 2 * len(shares) <= SMALL), "found")
    one, other = found.select("g", F.col("rank").alias("low"), F.col("v").alias("low_v")), found.select("g", F.col("rank").alias("high"), F.col("v").alias("high_v"))
    each = asked.join(one, ["g", "low"]).join(other, ["g", "high"]).withColumn("v", F.expr("if(part = 0, low_v, low_v * (1 - part) + high_v * part)"))
    q = each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("q"))
    return q.select(*(F.col("g")[c].alias(c) for c in keys), "q")
