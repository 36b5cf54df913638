"""Turns of conversations in order, without a task that holds a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import Scratch, ship


def turns(conversations: DataFrame, blank: str = "") -> DataFrame:
    """conv_id, turn, role, text of rows with a conv_id, null roles and texts as `blank`; other columns are left out."""
    ship(conversations.sparkSession)
    some = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(blank)).alias(c) for c in ("role", "text")))
    return some.where("conv_id is not null")


def digest(*columns: str):
    """16 bytes that stand for the strings."""
    return F.unhex(F.md5(F.concat(*(x for c in columns for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))))))


def in_order(df: DataFrame, key: str, order: list, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """df as a table in the order of key and `order` with pid and mid, its part and place, and the pieces of each key:
    key, pid, first (its least mid), n (rows) and before (its rows in earlier parts).

    Rows are dealt out by ranges of the whole order, so a key with any share of the rows is spread over tasks; a piece
    is a row for each key and part.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    rows = scratch.table(dealt.withColumn("mid", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("mid", 33)), name)
    pieces = rows.groupBy(key, "pid").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return rows, pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
