"""Maximum inner product search: score-aware quantisation, four-bit tables, exact reranking.

Rows are dealt out to cells about coarse centres, and a query visits the cells of largest product with it, as many as
a sample of exact answers asks for, and then those that may still hold a better answer. In a cell the codes are looked
up in byte tables, and the best go on to their exact product, with all whose error bound leaves them open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.session import Scratch, ship

CENTRES = 16
#: Rows of a cell on average, and cells at most.
CELL, MOST_CELLS = 2048, 256
#: Rows of a block of a cell, and of a block of queries that meets it.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Parts in which the answers of a query's blocks are merged before they meet.
MERGED = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part: no nulls, finite, not all zero, of the most common length."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    own = own.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    wide = own.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    return own.where(F.size("v") == (wide["n"] if wide else 0))


class ScoreAwareQuantizer:
    """Codes of 16 centres for each pair of dimensions.

    The loss of a residual r of x is eta * |parallel part|^2 + |orthogonal part|^2, parallel to x: errors along x
    change the large inner products most. threshold is the share of |x| from which a product counts as large.
    """

    def __init__(self, wide: int, per: int = 2, threshold: float = 0.2, seed: int = 5):
        self.wide, self.per, self.parts, self.seed = wide, per, -(-wide // per), seed
        t2 = threshold * threshold
        self.eta = max(1.0, (wide - 1) * t2 / (1 - t2))
        self.centres = np.zeros((self.parts, CENTRES, per))

    def _split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.per))
        out[:, : self.wide] = x
        return out.reshape(len(x), self.parts, self.per)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (rows x parts), by coordinate descent on the anisotropic loss from the nearest centres."""
        z = self._split(x)
        unit = z / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        gap = z[:, :, None, :] - self.centres[None]
        square, along = (gap**2).sum(3), (gap * unit[:, :, None, :]).sum(3)
        codes = square.argmin(2)
        if self.eta > 1:
            total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
            rows = np.arange(len(x))
            for _ in range(sweeps):
                for m in range(self.parts):
                    rest = total - along[rows, m, codes[:, m]]
                    codes[:, m] = (square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                    total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def fit(self, x: np.ndarray, rounds: int = 6) -> None:
        """Centres that lower the loss of x, in turns with its codes."""
        g, z = np.random.default_rng(self.seed), self._split(x)
        if not len(x):
            return
        for m in range(self.parts):
            self.centres[m] = z[g.choice(len(x), CENTRES, replace=len(x) < CENTRES), m]
        unit = z / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        for step in range(rounds):
            codes = self.encode(x, 0 if step < rounds // 2 else 2)
            along = np.stack([((z[:, m] - self.centres[m, codes[:, m]]) * unit[:, m]).sum(1) for m in range(self.parts)], 1)
            total = along.sum(1)
            for m in range(self.parts):
                rest = total - along[:, m]
                for c in range(CENTRES):
                    own = codes[:, m] == c
                    if own.any():  # least squares: sum of (I + (eta - 1) u u') c = sum of (I + (eta - 1) u u') z + (eta - 1) u rest
                        u, t = unit[own, m], z[own, m]
                        left = own.sum() * np.eye(self.per) + (self.eta - 1) * u.T @ u
                        right = t.sum(0) + (self.eta - 1) * (u * ((u * t).sum(1) + rest[own])[:, None]).sum(0)
                        self.centres[m, c] = np.linalg.solve(left, right)
                new = ((z[:, m] - self.centres[m, codes[:, m]]) * unit[:, m]).sum(1)
                total += new - along[:, m]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x parts x 16: the inner product of each query's part with each centre."""
        return np.einsum("qmd,mcd->qmc", self._split(queries), self.centres).astype(np.float32)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows x parts) stand for."""
        return self.centres[np.arange(self.parts), codes].reshape(len(codes), -1)[:, : self.wide]

    def byte_tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes of a packed code x 256: tables() scaled to 0..255 for each query, a pair of parts added up, so that sums fit 16 bits."""
        return self.bounded_tables(queries)[0]

    def bounded_tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """byte_tables(), and base and step of each query: a product with a decoded vector is at most base + step * (sum of its entries)."""
        t = self.tables(queries)
        if self.parts % 2:
            t = np.concatenate([t, np.zeros((len(t), 1, CENTRES), t.dtype)], 1)
        low = t.min(2, keepdims=True)
        size = np.abs(t).max(2).sum(1, dtype=float)
        t = t - low
        step = np.maximum(t.max((1, 2)), 1e-30).astype(float) / 255
        # entries are rounded by half a step each, and tables() to single precision
        base = low.sum((1, 2), dtype=float) + step * t.shape[1] * 0.501 + 1e-5 * size
        t = np.rint(t / step[:, None, None]).astype(np.uint16)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(t), -1, 256), base, step


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return codes[:, 0::2] | codes[:, 1::2] << 4


def scanned(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x rows: the sum of the table entries of each row's packed code."""
    out = np.zeros((len(tables), len(codes)), np.uint16)
    for k in range(codes.shape[1]):
        out += tables[:, k].take(codes[:, k], axis=1)
    return out


class Cells:
    """Coarse centres of a sample, and how many cells a query has to visit."""

    def __init__(self, x: np.ndarray, cells: int, k: int, share: float = 0.99, seed: int = 9):
        g = np.random.default_rng(seed)
        self.centres = x[g.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
        for _ in range(10 if len(self.centres) > 1 else 0):
            own = self.assign(x)
            for c in np.unique(own):
                self.centres[c] = x[own == c].mean(0)
        self.probes = 1
        if len(self.centres) > 1:  # the cells of the sample's exact answers, by their place in the query's order
            q = x[g.choice(len(x), min(len(x), 512), replace=False)]
            score = q @ x.T
            top = np.argpartition(-score, min(k, len(x) - 1), 1)[:, : k + 1]
            place = np.argsort(np.argsort(-(q @ self.centres.T), 1), 1)
            at = np.take_along_axis(place, self.assign(x)[top], 1)
            self.probes = min(len(self.centres), 1 + int(np.quantile(at, share, method="higher")))

    def assign(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def visited(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells each query visits: `probes` of them, and more until they hold `least` rows, if all do; sizes: rows of each cell."""
        order = np.argsort(-(q @ self.centres.T), 1, kind="stable")
        enough = 1 + (np.cumsum(sizes[order], 1) < least).sum(1)
        return [o[: max(self.probes, n)] for o, n in zip(order, enough, strict=True)]

    def possible(self, q: np.ndarray, far: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """The cells that may hold a product of `least` or more with each query; far: greatest distance of a cell's rows from its centre, negative without rows."""
        size = np.linalg.norm(q, axis=1)[:, None]
        most = q @ self.centres.T + size * np.maximum(far, 0) + 1e-9 * size * (np.linalg.norm(self.centres, axis=1) + np.maximum(far, 0))
        return [np.flatnonzero(m) for m in (most >= least[:, None]) & (far >= 0)]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = 10, most_trained: int = 8192,
            cell: int = CELL, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k others of largest inner product.

    The quantizer and the cells learn from at most most_trained vectors, the first by hash of the id; every row is
    indexed. Each query first visits as many cells as hold 0.99 of the sample's own nearest, and k others; then all others that
    may hold a better answer than its k-th so far, by the greatest distance of a cell's rows from its centre. In a block of a cell byte tables
    give approximate products, the best rerank * k get their exact product, and so do further rows whose approximate product
    and error (|q| |x - decoded x|) don't rule them out; the block's k best go on. So the answers are the truly nearest whatever the
    rows are like; what the sample was like decides the work alone. Vectors that
    are equal are one vector until the end; of those only the k + 1 smallest ids can be among anyone's k nearest. Ties
    go to the smaller id. Vectors that are null, all zero, not finite or of another length than most take no part, nor
    do rows without id. A repeated id is a query once for each of its different vectors, whose answers then share its
    query_id, and may be an answer of others again for each. A query goes on to further cells until those it visits have
    k rows of other ids, so fewer than k come back only where there are fewer. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "nearest")
    own = usable(vectors, id_col, vector_col).distinct()
    wide = own.select(F.size("v")).first()
    wide = wide[0] if wide else 1
    # of equal vectors the k + 1 smallest ids: first in salted groups, then of those
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")
    pre = Window.partitionBy("v", "salt").orderBy("vec_id")
    few = own.select("vec_id", "v", salt).withColumn("place", F.row_number().over(pre)).where(F.col("place") <= k + 1)
    few = scratch.table(few.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1).select("vec_id", "v"), "few")
    sample = np.array(few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_trained).toArrow().column("v").to_pylist(), float).reshape(-1, wide)
    quantizer = ScoreAwareQuantizer(wide)
    quantizer.fit(sample)
    n = few.count()
    cells = Cells(sample, max(1, min(MOST_CELLS, n // cell)), k)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, wide)
                codes, cell_of = quantizer.encode(x), cells.assign(x)
                off, far = np.linalg.norm(x - quantizer.decoded(codes), axis=1), np.linalg.norm(x - cells.centres[cell_of], axis=1)
                columns = [pa.array(cell_of.astype(np.int32)), pa.array([c.tobytes() for c in packed(codes)], pa.binary()), pa.array(off), pa.array(far)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["vec_id", "v", "cell", "code", "bound", "far"])

    def visits(batches):
        for batch in batches:
            if batch.num_rows:
                found = cells.visited(np.asarray(batch.column(1).flatten()).reshape(-1, wide), sizes, k + same)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))], ["vec_id", "v", "cells"])

    def further(batches):
        """The cells not visited that may hold a row as near as the k-th so far."""
        for batch in batches:
            if batch.num_rows:
                q = np.asarray(batch.column(1).flatten()).reshape(-1, wide)
                first = cells.visited(q, sizes, k + same)
                found = [np.setdiff1d(p, f) for p, f in zip(cells.possible(q, far, np.asarray(batch.column(2))), first, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))], ["vec_id", "v", "bound", "cells"])

    indexed = scratch.table(few.mapInArrow(index, "vec_id long, v array<double>, cell int, code binary, bound double, far double"), "index")
    scratch.drop("few")
    # a query needs k rows beside those of its own id, of which there are `same` at most
    sizes, far = np.zeros(len(cells.centres), np.int64), np.full(len(cells.centres), -1.0)
    for c, count, most in indexed.groupBy("cell").agg(F.count("*"), F.max("far")).collect():  # MOST_CELLS rows
        sizes[c], far[c] = count, most
    same = indexed.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    asked = own.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    number = lambda n, *salts: F.pmod(F.xxhash64("vec_id", "v", *salts), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "r", "q", "vec_id", "v", "code", "bound"]

    def search(key, table):
        ids, v, code = (table.column(n) for n in ("vec_id", "v", "code"))
        is_query, bound = np.asarray(code.is_null()), np.asarray(table.column("bound"))  # the k-th product so far of a query, the error of a row
        ids, v = np.asarray(ids), np.asarray(v.combine_chunks().flatten()).reshape(-1, wide)
        query_ids, query, row_ids, row = ids[is_query], v[is_query], ids[~is_query], v[~is_query]
        order = np.argsort(row_ids, kind="stable")
        codes = np.frombuffer(b"".join(code.drop_null().to_pylist()), np.uint8).reshape(len(row_ids), -(-quantizer.parts // 2))[order]
        row_ids, row, least, off = row_ids[order], row[order], bound[is_query], bound[~is_query][order]
        most = min(len(row_ids), rerank * k + same)
        out = []
        for a in range(0, len(query_ids) if most else 0, 128):
            some, some_ids = query[a : a + 128], query_ids[a : a + 128]
            if most < len(row_ids):
                tables, base, step = quantizer.bounded_tables(some)
                rough = scanned(tables, codes)
                top = np.sort(np.argpartition(rough, len(row_ids) - most, 1)[:, len(row_ids) - most :], 1)
            else:
                top = np.broadcast_to(np.arange(most), (len(some), most))
            exact = np.einsum("qd,qnd->qn", some, row[top])
            exact[row_ids[top] == some_ids[:, None]] = -np.inf
            if most < len(row_ids):
                size, kth = np.linalg.norm(some, axis=1), least[a : a + 128]
                if most >= k:
                    kth = np.maximum(kth, np.partition(exact, most - k, 1)[:, most - k])
                slack = 1e-9 * size * np.linalg.norm(row, axis=1).max()
                open_ = base[:, None] + step[:, None] * rough + size[:, None] * off >= (kth - slack)[:, None]
                np.put_along_axis(open_, top, False, 1)
                open_ &= row_ids != some_ids[:, None]
                at = np.flatnonzero(open_.any(0))
                if len(at):  # rows that the bounds don't rule out for some query
                    product = np.where(open_[:, at], some @ row[at].T, -np.inf)
                    if len(at) > k:
                        kth = np.maximum(kth, np.partition(product, len(at) - k, 1)[:, len(at) - k])
                    good = product >= (kth - slack)[:, None]
                    good &= product > -np.inf
                    count = good.sum(1)
                    asks_of, row_of = np.nonzero(good)
                    more = np.full((len(some), count.max()), -1)
                    more[asks_of, np.arange(len(asks_of)) - np.repeat(np.cumsum(count) - count, count)] = at[row_of]
                    added = np.einsum("qd,qnd->qn", some, row[more])
                    added[more < 0] = -np.inf
                    top, exact = np.concatenate([top, more], 1), np.concatenate([exact, added], 1)
            exact[exact < least[a : a + 128, None]] = -np.inf
            best = np.lexsort((row_ids[top], -exact), axis=1)[:, :k]
            score = np.take_along_axis(exact, best, 1)
            keep = score > -np.inf
            out.append((some_ids, keep.sum(1), row_ids[np.take_along_axis(top, best, 1)][keep], score[keep]))
        whole = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.int64, float))]
        pairs = pa.StructArray.from_arrays([pa.array(0.0 - whole[3]), pa.array(whole[2])], ["minus", "vec_id"])
        part = np.full(len(whole[0]), (key[0].as_py() * 31 + key[1].as_py()) % MERGED, np.int32)
        return pa.table({"query_id": whole[0], "part": part, "best": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(whole[1])]).astype(np.int32)), pairs)})

    merged = lambda df, *keys: df.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))

    def answers(queries: DataFrame) -> DataFrame:
        """query_id, best: the k best among the cells of queries (vec_id, v, bound, cell), none below bound."""
        both_blocks = F.broadcast(blocks(indexed, block_rows, "row_blocks").join(blocks(queries, block_queries, "query_blocks"), "cell"))  # MOST_CELLS rows
        rows = indexed.join(both_blocks, "cell").withColumn("r", number("row_blocks")).withColumn("q", others("query_blocks"))
        asks = queries.join(both_blocks, "cell").withColumn("q", number("query_blocks", F.lit(1))).withColumn("r", others("row_blocks")).withColumn("code", F.lit(None).cast("binary"))
        found = rows.select(*columns).unionByName(asks.select(*columns)).groupBy("cell", "r", "q").applyInArrow(search, "query_id long, part int, best array<struct<minus: double, vec_id: long>>")
        return merged(merged(found, "query_id", "part"), "query_id")

    first = asked.mapInArrow(visits, "vec_id long, v array<double>, cells array<int>").select("vec_id", "v", F.lit(float("-inf")).alias("bound"), F.explode("cells").alias("cell"))
    near = scratch.table(answers(scratch.table(first, "queries")), "near")
    # the k-th product so far; minus infinity where there are fewer
    kth = near.select(F.col("query_id").alias("vec_id"), F.when(F.size("best") >= k, -F.col("best")[k - 1]["minus"]).otherwise(float("-inf")).alias("bound"))
    rest = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    rest = scratch.table(rest.mapInArrow(further, "vec_id long, v array<double>, bound double, cells array<int>").select("vec_id", "v", "bound", F.explode("cells").alias("cell")), "further")
    whole = merged(near.unionByName(answers(rest)), "query_id")
    each = whole.select("query_id", F.posexplode("best").alias("place", "b"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", (F.lit(0.0) - F.col("b.minus")).alias("score"))
