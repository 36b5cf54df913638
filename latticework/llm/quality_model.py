"""Quality scores: random-indexing word vectors, pooled, through a two-layer network with a calibrated temperature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import Spans, balanced, documents, mix, tidied
from latticework.llm.labels import held_out, training_rows
from latticework.session import Scratch

WORDS, SHAPES, WIDE = 8192, 128, 32
#: Bytes of text that a worker looks at at once.
CHUNK = 1 << 19
TERMS = WORDS + SHAPES
BLOCK = 128
KIND = np.full(256, 3, np.uint8)  # of bytes: 0 letters and other scripts, 1 digits, 2 full stop or comma, 3 the rest
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
KIND[48:58] = 1
KIND[[44, 46]] = 2
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
UPPER[195] = True  # first byte of accented Latin letters


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the two entries of each term's sparse random vector."""
    h = mix(np.arange(TERMS, dtype=np.uint64) + np.uint64(99))
    first = (h % np.uint64(WIDE)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(16)) % np.uint64(WIDE - 1)).astype(np.int64)) % WIDE
    signs = np.stack([(h >> np.uint64(40)) & np.uint64(1), (h >> np.uint64(41)) & np.uint64(1)], 1).astype(float) * 2 - 1
    return np.stack([first, second], 1), signs


PLACES, SIGNS = index_vectors()


def term_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hashed term, the term of its shape (endings, case, repeat of the word before), its document number."""
    raw = [t.encode() for t in texts]
    spans = Spans(raw)
    starts, ends, doc = spans.words()
    h = spans.hashes(starts, ends)
    word = (h >> np.uint64(51)).astype(np.int64)
    buf, one = spans.buf, ends - starts == 1
    last, late = buf[ends - 1], buf[np.maximum(ends - 2, starts)]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    caps = UPPER[buf[starts]] & UPPER[buf[np.minimum(starts + np.where(buf[starts] == 195, 2, 1), ends - 1)]] & ~one
    shape = WORDS + KIND[last].astype(np.int64) + 4 * (KIND[late] == 3) + 8 * caps + 16 * same + 32 * one
    return word, shape, doc


def corpus_vectors(docs: DataFrame, reach: int = 2) -> np.ndarray:
    """TERMS x WIDE word vectors: sums of the index vectors of all terms within `reach` of each occurrence in docs.

    Every task adds up a table of fixed size for its rows; Spark sums these, whole numbers, by blocks of terms.
    """

    def run(batches):
        total = np.zeros(TERMS * WIDE)
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                word, shape, doc = term_pairs([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                term, of = np.stack([word, shape], 1).ravel(), np.repeat(doc, 2)
                for k in range(1, reach + 1):
                    a, b = term[:-k], term[k:]
                    near = of[:-k] == of[k:]
                    a, b = a[near], b[near]
                    for e in range(2):
                        total += np.bincount(a * WIDE + PLACES[b, e], SIGNS[b, e], TERMS * WIDE)
                        total += np.bincount(b * WIDE + PLACES[a, e], SIGNS[a, e], TERMS * WIDE)
        blocks = total.reshape(-1, BLOCK * WIDE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.astype("<i8").tobytes() for b in blocks], pa.binary())], ["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])

    out = np.zeros((TERMS // BLOCK, BLOCK * WIDE))
    parts = docs.mapInArrow(tidied(run), "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary")
    for r in parts.toArrow().to_pylist():
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(TERMS, WIDE)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[str]) -> np.ndarray:
    """Mean vector of the words and of the shapes of each text, side by side; zeros without words."""
    word, shape, doc = term_pairs(texts)
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), 2 * WIDE))
    has = np.flatnonzero(n)
    if len(has):
        first = np.concatenate([[0], np.cumsum(n[has])])[:-1]
        out[has, :WIDE] = np.add.reduceat(vectors[word], first, axis=0) / n[has, None]
        of_shape = np.bincount(doc * SHAPES + shape - WORDS, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
        out[:, WIDE:] = of_shape @ vectors[WORDS:] / np.maximum(n, 1)[:, None]
    return out


class Network:
    """Standardised inputs, one hidden layer of tanh units, one logit, divided by a temperature."""

    def __init__(self, wide: int, hidden: int = 24, seed: int = 11):
        g = np.random.default_rng(seed)
        self.a, self.a0 = g.normal(0, 1 / np.sqrt(wide), (wide, hidden)), np.zeros(hidden)
        self.b, self.b0 = g.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)
        self.mean, self.scale, self.temperature = np.zeros(wide), np.ones(wide), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.a + self.a0) @ self.b + self.b0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Weights from six sevenths of the rows; the temperature that gives the rest the least log loss."""
        if not len(y):
            return
        rest = np.arange(len(y)) % 7 == 6
        test, train = (rest, ~rest) if rest.sum() >= 20 else (np.ones(len(y), bool),) * 2
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-3
        z, t = (x[train] - self.mean) / self.scale, y[train]
        params = [self.a, self.a0, self.b, self.b0]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, steps + 1):
            hidden = np.tanh(z @ self.a + self.a0)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ self.b + self.b0, -30, 30))) - t) / len(t)
            inner = np.outer(wrong, self.b) * (1 - hidden**2)
            grads = [z.T @ inner + decay * self.a, inner.sum(0), hidden.T @ wrong + decay * self.b, np.array([wrong.sum()])]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        raw, t = self.logits(x[test]), y[test]

        def loss(temperature):
            s = raw / temperature
            return np.mean(np.logaddexp(0, s) - t * s)

        self.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))


def learn_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs, and the network from at most most_rows labelled rows."""
    vectors = corpus_vectors(docs)

    def run(batches):
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                x = pooled(vectors, [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"])

    rows = training_rows(docs, labels, "quality", most_rows)
    got = rows.mapInArrow(tidied(run), T.StructType([rows.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist())).reshape(-1, 2 * WIDE)
    network = Network(2 * WIDE)
    network.fit(x, np.asarray(got.column("label").to_numpy(), float))
    return vectors, network


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row of docs.

    Word vectors are gathered from all of docs; labels (doc_id, quality) come from at most most_rows rows that aren't
    held out; no other column enters a score. Null and empty texts pool to zeros and are scored as such; repeated
    rows get the same score each; without any label the network is untrained. An empty table gives an empty table;
    other columns are ignored.
    """
    src = documents(docs, id_col, text_col)
    vectors, network = learn_quality(src, labels, most_rows)

    def run(batches):
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                x = pooled(vectors, [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(network.scores(x))], ["doc_id", "score"])

    scored = src.mapInArrow(tidied(run), T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that quality() would give a score of threshold or more."""
    vectors, network = learn_quality(documents(docs, id_col, text_col), labels, most_rows)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(network.scores(pooled(vectors, [t or "" for t in text.slice(i, j - i).to_pylist()]))) for i, j in balanced(text, CHUNK)])

    return docs.where(score(F.col(text_col)) >= threshold)
