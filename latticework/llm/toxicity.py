"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import Spans, balanced, documents, mix, tidied
from latticework.llm.labels import held_out, training_rows
from latticework.session import Scratch

BITS = 18
#: Bytes of text that a worker looks at at once.
CHUNK = 1 << 19
#: A term is a run of ASCII letters and digits or other characters' bytes.
APART = np.ones(256, bool)
APART[128:] = False
APART[[*range(48, 58), *range(97, 123)]] = False
#: Besides whole words, their beginnings of so many bytes are terms, so that inflected forms share a feature.
BEGINNINGS = (4, 5, 6)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of each text and their document numbers, repeats included."""
    spans = Spans([t.lower().encode() for t in texts])
    starts, ends, doc = spans.words(APART)
    kinds = [spans.hashes(starts, ends)]
    for k, n in enumerate(BEGINNINGS, 1):
        kinds.append(mix(spans.hashes(starts, np.minimum(ends, starts + n)) + np.uint64(k)))
    return np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in kinds]), np.tile(doc, len(kinds))


def _once(feature: np.ndarray, doc: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(doc.astype(np.int64) * n_features + feature)
    return pairs % n_features, pairs // n_features


class FactorizationMachine:
    """Logit bias + sum of w over a row's features + sum of <v_i, v_j> over its pairs of features."""

    def __init__(self, n_features: int, factors: int = 8, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n_features)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n_features, factors))

    def logits(self, feature: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.w[feature], n_rows)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            out += 0.5 * (np.bincount(row, x, n_rows) ** 2 - np.bincount(row, x * x, n_rows))
        return out

    def fit(self, feature: np.ndarray, row: np.ndarray, label: np.ndarray, rounds: int = 12, least_steps: int = 300, batch: int = 256, rate: float = 0.02, decay_w: float = 1e-5, decay_v: float = 1e-4, seed: int = 3) -> None:
        """Adam over batches of rows in random order, `rounds` times through all, and as often again as least_steps takes; the rate falls to a tenth. row is in order.

        The decays pull w and v to 0, v more, so that a pair counts only where it tells more than its parts.
        """
        n, params = len(label), [np.zeros(1), self.w, self.v]
        if not n:
            return
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        share = np.clip(label.mean(), 0.01, 0.99)
        self.bias = params[0][0] = np.log(share / (1 - share))
        size = np.bincount(row, minlength=n)
        start, g, t = np.cumsum(size) - size, np.random.default_rng(seed), 0
        batches = -(-n // batch)
        rounds = max(rounds, -(-least_steps // batches))
        steps = rounds * batches
        for _ in range(rounds):
            order = g.permutation(n)
            for k in range(0, n, batch):
                some, t = order[k : k + batch], t + 1
                m, own = len(some), np.repeat(np.arange(len(some)), size[some])
                of = feature[np.repeat(start[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(len(own))]
                wrong = (1 / (1 + np.exp(-np.clip(self.logits(of, own, m), -30, 30))) - label[some]) / m
                each = wrong[own]
                grads = [np.array([wrong.sum()]), np.bincount(of, each, len(self.w)) + decay_w * self.w, decay_v * self.v]
                for f in range(self.v.shape[1]):
                    x = self.v[of, f]
                    grads[2][:, f] += np.bincount(of, each * (np.bincount(own, x, m)[own] - x), len(self.w))
                speed = rate * (1 - 0.9 * t / steps)
                for p, d, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= speed * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                self.bias = float(params[0][0])


def telling_terms(rows: DataFrame, errors: float, common: float) -> DataFrame:
    """feature: the terms of labelled rows (doc_id, label, features) that enter the machine.

    A term tells if three rows have it, and their share of toxic ones is off that of all rows by `errors` standard
    errors, either way. Those that tell toward toxic alone mark rows; other terms tell with them if they are so far off
    among the marked rows, however harmless they are elsewhere. Terms in a share `common` of the rows enter whatever
    they tell, as pairs of them may. Their number is bounded by that of terms, 2^BITS.
    """

    def off(some):
        """feature, n, of (rows), z: standard errors off the share of toxic rows."""
        size = some.agg(F.count("*").alias("of"), F.avg("label").alias("share"))
        counts = some.select(F.explode("features").alias("feature"), "label").groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
        spread = F.sqrt(F.expr("n * share * (1 - share) * (1 - n / of)") + 1e-9)
        return counts.crossJoin(F.broadcast(size)).select("feature", "n", "of", (F.expr("toxic - n * share") / spread).alias("z"))

    alone = off(rows)
    toxic = alone.where((F.col("n") >= 3) & (F.col("z") >= errors)).select("feature")
    marked = rows.select("row", F.explode("features").alias("feature")).join(toxic, "feature", "left_semi").select("row").distinct()
    together = off(rows.join(marked, "row", "left_semi")).where((F.col("n") >= 3) & (F.abs("z") >= errors))
    return alone.where(((F.col("n") >= 3) & (F.abs("z") >= errors)) | (F.col("n") >= common * F.col("of"))).select("feature").union(together.select("feature")).distinct()


def learn_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, errors: float = 5.0, common: float = 0.1, factors: int = 8):
    """The slot of each hashed term (-1: none) and the machine, from at most most_rows labelled rows.

    Spark counts the terms in these rows; those that telling_terms picks go to the driver, which fits the machine.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.table(training_rows(docs, labels, "toxic", most_rows), "sample")

    def rows(batches):
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                n = j - i
                feature, doc = _once(*terms([t or "" for t in batch.column(1).slice(i, n).to_pylist()]), 1 << BITS)
                lists = np.split(feature.astype(np.int32), np.cumsum(np.bincount(doc, minlength=n))[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "label", "features"])

    own = sample.select("doc_id", "text", "label").mapInArrow(tidied(rows), T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))]))
    kept = scratch.table(own.withColumn("row", F.monotonically_increasing_id()), "features")
    chosen = scratch.table(telling_terms(kept, errors, common), "chosen")
    slots = np.full(1 << BITS, -1, np.int32)
    slots[np.sort(chosen.toArrow().column(0).to_numpy())] = np.arange(chosen.count())
    pairs = kept.select("row", F.explode("features").alias("feature")).join(chosen, "feature", "left_semi").toArrow()
    got = kept.select("row", "doc_id", "label").toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    names, row = np.asarray(got.column("row")), np.asarray(pairs.column("row"))
    place = np.argsort(names)
    at = place[np.searchsorted(names[place], row)]
    feature = slots[np.asarray(pairs.column("feature"))]
    order = np.lexsort((feature, at))
    machine = FactorizationMachine(max(1, int(slots.max()) + 1), factors)
    machine.fit(feature[order], at[order], np.asarray(got.column("label").to_numpy(), float))
    for name in ("sample", "features", "chosen"):
        scratch.drop(name)
    return slots, machine


def _active(slots: np.ndarray, n_slots: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    feature, doc = terms(texts)
    at = slots[feature]
    has = at >= 0
    return _once(at[has], doc[has], max(1, n_slots))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row of docs.

    Learns from `labels` (doc_id, toxic) as learn_toxicity says; no other column enters a score. Null and empty
    texts have no terms and get the score of the bias; repeated rows the same score each; without any label all
    scores are equal. An empty table gives an empty table; other columns are ignored.
    """
    src = documents(docs, id_col, text_col)
    slots, machine = learn_toxicity(src, labels, most_rows)
    model = src.sparkSession.sparkContext.broadcast((slots, machine))

    def run(batches):
        slots, machine = model.value
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                n = j - i
                feature, doc = _active(slots, len(machine.w), [t or "" for t in batch.column(1).slice(i, n).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(machine.logits(feature, doc, n), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(score)], ["doc_id", "score"])

    scored = src.mapInArrow(tidied(run), T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
