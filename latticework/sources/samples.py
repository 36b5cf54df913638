"""The sample store: Parquet (base, block, sample, idx, re, im) in pieces by blocks of 4096 indices, and manifests that say which pieces count.

A piece is a folder of its own that no one sees until a manifest of the next number, which lists the pieces of all
bases, is renamed to its name. So writes of several bases become visible at once or not at all, readers never meet a
half-written one, and of two writers that start from one manifest only the first succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources.points import gaussian_vectors

BASES = ("y_test", "y_sketch", "z_test", "z_sketch")
WIDE = 4096


def canonical(base: str) -> str:
    """y_test for ytest, Y-Test, and so on."""
    plain = base.lower().replace("-", "").replace("_", "").replace(" ", "")
    for b in BASES:
        if plain == b.replace("_", ""):
            return b
    raise ValueError(f"unknown sample base {base!r}; known: {BASES}")


class Store:
    """A folder of samples as its last manifest has it: version and, by base, pieces, samples, indices, blocks and whether they are complex."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.bases = 0, {}
        top = self.path(f"{self.folder}/manifests")
        if self.files.exists(top):
            numbers = [int(n) for n in (f.getPath().getName() for f in self.files.listStatus(top)) if n.isdigit()]
            if numbers:
                self.version = max(numbers)
                self.bases = json.loads(spark.read.text(self._name(self.version), wholetext=True).first()[0])

    def _name(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}"

    def stage(self, own: DataFrame, base: str, after: bool) -> dict:
        """Writes rows of a base as a piece that nobody sees yet; after: numbered behind the base's samples, which they must fit. Returns the base as it would be."""
        old = self.bases.get(base) if after else None
        piece = f"pieces/{uuid.uuid4().hex}"
        # a task has WIDE samples of WIDE indices
        own.drop("base").repartition("block", F.expr(f"sample div {WIDE}")).write.partitionBy("block").parquet(f"{self.folder}/{piece}")
        kind = "sample long, idx long, re double, im double, block long"
        r = self.spark.read.schema(kind).parquet(f"{self.folder}/{piece}").agg(F.min("sample").alias("low"), F.max("sample").alias("high"), F.max("idx").alias("top"), F.count_distinct("block").alias("blocks"), F.count("im").alias("n_im"), F.count("*").alias("n")).first()
        if not r["n"]:
            return old or {"pieces": [], "samples": 0, "indices": 0, "blocks": 0, "complex": False}
        is_complex = r["n_im"] == r["n"]
        if old and old["samples"]:
            if r["top"] + 1 != old["indices"]:
                raise ValueError(f"{base}: {r['top'] + 1} indices, the store has {old['indices']}")
            if is_complex != old["complex"]:
                raise ValueError(f"{base}: real and complex samples can't be mixed")
        have = old["samples"] if old else 0
        # samples that are written afresh keep their numbers; added ones get those behind, by the shift that the manifest has
        shift = have - r["low"] if old and old["samples"] else 0
        pieces = [*(old["pieces"] if old else []), {"path": piece, "shift": shift}]
        return {"pieces": pieces, "samples": r["high"] + shift + 1, "indices": r["top"] + 1, "blocks": r["blocks"], "complex": is_complex}

    def commit(self, bases: dict) -> None:
        """Makes the staged bases visible, all at once; an error if another writer did so since this store was opened."""
        draft = self.path(f"{self.folder}/manifests/_{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        stream.write(bytearray(json.dumps(self.bases | bases).encode()))
        stream.close()
        to = self.path(self._name(self.version + 1))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, to, none)  # never over a file that is there
        except Exception as e:
            self.files.delete(draft, False)
            if self.files.exists(to):
                raise ValueError(f"{self.folder}: another writer has added to the store meanwhile") from e
            raise
        self.version, self.bases = self.version + 1, self.bases | bases

    def rows(self, base: str) -> DataFrame | None:
        """sample, idx, re, im of a base."""
        own, out = self.bases.get(base), None
        for piece in own["pieces"] if own else []:
            part = self.spark.read.schema("sample long, idx long, re double, im double, block long").parquet(f"{self.folder}/{piece['path']}")
            part = part.select((F.col("sample") + F.lit(piece["shift"])).alias("sample"), "idx", "re", "im")
            out = part if out is None else out.unionByName(part)
        return out


def read_samples(spark: SparkSession, base: str, *folders: str) -> DataFrame | None:
    """sample, idx, re, im of a base, from the first folder that has it; None if none has."""
    for folder in folders:
        own = Store(spark, folder).rows(canonical(base))
        if own is not None:
            return own
    return None


def sample_shape(spark: SparkSession, base: str, *folders: str) -> tuple[int, int] | None:
    """Numbers of samples and of indices, as the manifest has them; an error if a block is missing; None without a store."""
    for folder in folders:
        own = Store(spark, folder).bases.get(canonical(base))
        if own and own["samples"]:
            if -(-own["indices"] // WIDE) != own["blocks"]:
                raise ValueError(f"{base}: {own['blocks']} blocks of {own['indices']} indices")
            return own["samples"], own["indices"]
    return None


def _blocks(samples: DataFrame, base: str, force_complex: bool) -> DataFrame:
    im = F.coalesce("im", F.lit(0.0)) if force_complex and "im" in samples.columns else F.lit(0.0) if force_complex else F.col("im") if "im" in samples.columns else F.lit(None).cast("double")
    return samples.select(F.lit(canonical(base)).alias("base"), F.expr(f"idx div {WIDE}").alias("block"), F.col("sample").cast("long"), "idx", "re", im.alias("im"))


def write_samples(samples: DataFrame, base: str, folder: str, force_complex: bool = True) -> None:
    """Replaces a base in the store; other bases stay."""
    store, base = Store(samples.sparkSession, folder), canonical(base)
    store.commit({base: store.stage(_blocks(samples, base, force_complex), base, after=False)})


def append_samples(samples: DataFrame, base: str, folder: str, force_complex: bool = True) -> None:
    """Adds samples after those of the store; another number of indices, or complex to real, is an error, and so is another writer meanwhile."""
    store, base = Store(samples.sparkSession, folder), canonical(base)
    store.commit({base: store.stage(_blocks(samples, base, force_complex), base, after=True)})


def ensure_samples(ids: DataFrame, wanted: int, folder: str, apply: Callable[[DataFrame, str], DataFrame], symmetric: bool = False, seed: int = 42, complex_values: bool = False) -> int:
    """Brings the store to `wanted` samples and returns how many were added: none if there are enough.

    y_test holds draws W and y_sketch their images A W; z_test and z_sketch hold conj W' and conj(A^T W'), left out
    for symmetric operators. Draws are real, or complex with complex_values. apply(x, mode) gives images. All bases
    become visible with one manifest: a run that stops earlier leaves the store as it was, and the next one adds what
    each side lacks. A base without its counterpart of the same length is an error.
    """
    store, staged, added = Store(ids.sparkSession, folder), {}, 0
    rows = lambda v: v.select(F.col("vec").alias("sample"), "idx", "re", "im")
    for side, mode, s in (("y", "none", seed),) if symmetric else (("y", "none", seed), ("z", "transpose", seed + 1)):
        test, sketch = (store.bases.get(f"{side}_{kind}", {}).get("samples", 0) for kind in ("test", "sketch"))
        if test != sketch:
            raise ValueError(f"{folder}: {test} samples of {side}_test and {sketch} of {side}_sketch")
        if test >= wanted:
            continue
        w = gaussian_vectors(ids, wanted, s, complex_values).where(F.col("sample") >= test).withColumnRenamed("sample", "vec")
        image = apply(w, mode)
        flip = (lambda v: v.withColumn("im", -F.col("im"))) if side == "z" else (lambda v: v)
        for base, v in ((f"{side}_test", w), (f"{side}_sketch", image)):
            staged[base] = store.stage(_blocks(rows(flip(v)), base, True), base, after=True)
        added = max(added, wanted - test)
    if staged:
        store.commit(staged)
    return added


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes pieces that the last manifest doesn't have, such as those of stopped runs, and older manifests; returns how many pieces. Not while others read or write."""
    store, n = Store(spark, folder), 0
    kept = {p["path"].rpartition("/")[2] for b in store.bases.values() for p in b["pieces"]}
    for top in ("pieces", "manifests"):
        at = store.path(f"{store.folder}/{top}")
        for f in store.files.listStatus(at) if store.files.exists(at) else []:
            name = f.getPath().getName()
            if name not in kept and name != f"{store.version:012d}":
                store.files.delete(f.getPath(), True)
                n += top == "pieces"
    return n
