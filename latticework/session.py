"""Session helpers shared by the whole package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by path, and hold the session's Arrow batches
    to BATCH_BYTES, unless a size is set, so that rows with long texts don't fill the workers."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local sessions may leave it unset, which then get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[\d*, ]+\])?$", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Those names, with underscores behind them where df has a column of that name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written under the shared folder, to cut lineage and to survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        path = f"{self.top}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def likely(df: DataFrame, ids: DataFrame, columns: list[str], buckets: int = 1 << 18) -> DataFrame:
    """Rows of df whose `columns` may be among those of ids: all that are, and some others.

    ids are hashed to at most `buckets` numbers, 8 bytes each, which are broadcast; so df is thinned without a shuffle
    at any size of ids, though less the more there are.
    """
    number, (bucket,) = F.pmod(F.xxhash64(*columns), F.lit(buckets)), spare(df, "_bucket")
    return df.join(F.broadcast(ids.select(number.alias(bucket)).distinct()), number == F.col(bucket), "left_semi")


def split_by(df: DataFrame, ids: DataFrame, columns: list[str], buckets: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Two parts of df: rows whose `columns` are certainly not among those of ids, and all others (see likely)."""
    number, (bucket,) = F.pmod(F.xxhash64(*columns), F.lit(buckets)), spare(df, "_bucket")
    found = F.broadcast(ids.select(number.alias(bucket)).distinct())
    return df.join(found, number == F.col(bucket), "left_anti"), df.join(found, number == F.col(bucket), "left_semi")
