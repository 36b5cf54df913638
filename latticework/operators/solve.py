"""Restarted GMRES over Spark jobs, and factors of diagonal blocks as its preconditioner."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.matrix import BLOCKS, TiledMatrix, add_blocks, added_blocks, apply_matrix, block_arrays, block_table, combine
from latticework.session import Scratch, ship

#: Rows of a diagonal block at most, whose square one task holds.
MOST_ROWS = 1024
#: Right-hand sides of one call at most: the driver holds restart + 1 by restart numbers for each.
MOST_VECTORS = 256


def _block_entries(a: DataFrame, boxes: DataFrame, most: int) -> DataFrame:
    """key, i, j, re, im of the diagonal blocks, duplicates added, and a row without j for each row of a box (key, idx); boxes of over `most` rows are an error."""
    top = boxes.groupBy("key").agg(F.count_distinct("idx").alias("n")).agg(F.max("n")).first()[0]
    if top is not None and top > most:
        raise ValueError(f"a box has {top} rows; a block of more than {most} is not held by a task")
    rows, columns = boxes.select("key", F.col("idx").alias("i")).distinct(), boxes.select("key", F.col("idx").alias("j")).distinct()
    own = a.join(rows, "i").join(columns, ["key", "j"]).groupBy("key", "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    none = F.lit(None)
    return own.unionByName(rows.select("key", "i", none.cast("long").alias("j"), none.cast("double").alias("re"), none.cast("double").alias("im")))


def _dense(ids: np.ndarray, t, re: str = "re", im: str = "im") -> np.ndarray:
    out = np.zeros((len(ids), len(ids)), complex)
    out[np.searchsorted(ids, t["i"]), np.searchsorted(ids, t["j"])] = t[re] + 1j * t[im]
    return out


def block_solve(a: DataFrame, boxes: DataFrame, x: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """vec, idx, re, im: for each box (key, idx) the solution of its diagonal block with the box's part of x.

    Each box is solved in its own group; boxes of over `most` rows and singular blocks are errors.
    """
    ship(a.sparkSession)
    entries = _block_entries(a, boxes, most).withColumn("vec", F.lit(None).cast("long"))
    right = x.join(boxes.select("key", "idx").distinct(), "idx").groupBy("key", F.col("idx").alias("i"), F.lit(None).cast("long").alias("j"), F.col("vec").cast("long").alias("vec")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def solve(table):
        t = table.to_pandas()
        v, ids = t[t["vec"].notna()], np.unique(t["i"])
        block = _dense(ids, t[t["j"].notna()])
        vecs = np.unique(v["vec"])
        b = np.zeros((len(ids), len(vecs)), complex)
        b[np.searchsorted(ids, v["i"]), np.searchsorted(vecs, v["vec"])] = v["re"] + 1j * v["im"]
        y = np.linalg.solve(block, b)
        return pa.table({"vec": np.repeat(vecs, len(ids)).astype(np.int64), "idx": np.tile(ids, len(vecs)).astype(np.int64), "re": y.T.real.ravel(), "im": y.T.imag.ravel()})

    return entries.unionByName(right).groupBy("key").applyInArrow(solve, "vec long, idx long, re double, im double")


FACTORS = "key long, i long, j long, re double, im double, inv_re double, inv_im double"


def block_factors(a: DataFrame, boxes: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """FACTORS: every entry of each box's diagonal block and of its inverse, to be stored and applied by a join (apply_inverse).

    Boxes of over `most` rows and singular blocks are errors.
    """
    ship(a.sparkSession)

    def factor(key, table):
        t = table.to_pandas()
        ids = np.unique(t["i"])
        block = _dense(ids, t[t["j"].notna()])
        inverse = np.linalg.inv(block)
        n = len(ids)
        return pa.table({"key": np.full(n * n, key[0].as_py(), np.int64), "i": np.repeat(ids, n).astype(np.int64), "j": np.tile(ids, n).astype(np.int64), "re": block.real.ravel(), "im": block.imag.ravel(), "inv_re": inverse.real.ravel(), "inv_im": inverse.imag.ravel()})

    return _block_entries(a, boxes, most).groupBy("key").applyInArrow(factor, FACTORS)


def inverse_entries(factors: DataFrame) -> DataFrame:
    """The inverses of block_factors as a matrix."""
    return factors.select("i", "j", F.col("inv_re").alias("re"), F.col("inv_im").alias("im"))


def apply_inverse(factors: DataFrame, x: DataFrame) -> DataFrame:
    """vec, idx, re, im: the inverses of block_factors times x."""
    return apply_matrix(inverse_entries(factors), x)


def block_errors(a: DataFrame, boxes: DataFrame, factors: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """key, n (rows), err_block and err_inverse of each box, for factors of a matrix that stands for a.

    err_block is |E - B| / |E| and err_inverse |B^-1 E - I|, in the 2-norm, for a's block E and the factors' block B;
    without entries in E, err_block is |B|.
    """
    ship(a.sparkSession)
    exact = _block_entries(a, boxes, most).select("key", "i", "j", "re", "im", F.lit(None).cast("double").alias("inv_re"), F.lit(None).cast("double").alias("inv_im"))

    def compare(key, table):
        t = table.to_pandas()
        ids, mine = np.unique(t["i"]), t["inv_re"].notna()
        e, b, inverse = _dense(ids, t[~mine & t["j"].notna()]), _dense(ids, t[mine]), _dense(ids, t[mine], "inv_re", "inv_im")
        size = np.linalg.norm(e, 2)
        return pa.table({"key": [key[0].as_py()], "n": [len(ids)], "err_block": [np.linalg.norm(e - b, 2) / (size or 1.0)], "err_inverse": [np.linalg.norm(inverse @ e - np.eye(len(ids)), 2)]})

    return exact.unionByName(factors.select(*exact.columns)).groupBy("key").applyInArrow(compare, "key long, n long, err_block double, err_inverse double")


class _Basis:
    """A cycle's vectors b0, b1, ... beside each other by vec and idx, and the last image w, which is yet to be made the next one.

    They are one table, bucketed and sorted by vec and idx, so a step shuffles the image alone, and dots and combinations
    are sums along a row. The next vector is (w - sum of h b) times a scale, both by vec.
    """

    KEYS = ("vec", "idx")

    def __init__(self, scratch: Scratch, w: DataFrame):
        self.scratch, self.spark, self.n, self.name = scratch, w.sparkSession, 0, ""
        self.table = w.select(*self.KEYS, F.col("re").alias("w_re"), F.col("im").alias("w_im"))

    def _with(self, h: dict[int, Iterable[complex]], scale: dict[int, float] | None = None, names: tuple[str, str] = ("v_re", "v_im"), start: bool = True) -> DataFrame:
        """The table and (w if start, minus the sum of h b) times scale; 0 for vectors that aren't in h."""
        values = {v: np.array(list(c), complex) for v, c in h.items()}
        columns = {"vec": np.array(list(values), np.int64), "_s": np.array([scale[v] if scale else 1.0 for v in values], float)}
        for j in range(max(map(len, values.values()), default=0)):
            here = np.array([c[j] if j < len(c) else 0j for c in values.values()], complex)
            columns |= {f"_h{j}_re": here.real.copy(), f"_h{j}_im": here.imag.copy()}
        terms = range((len(columns) - 2) // 2)
        re = " - ".join(["w_re" if start else "0D", *(f"(_h{j}_re * b{j}_re - _h{j}_im * b{j}_im)" for j in terms)])
        im = " - ".join(["w_im" if start else "0D", *(f"(_h{j}_re * b{j}_im + _h{j}_im * b{j}_re)" for j in terms)])
        joined = self.table.join(F.broadcast(self.spark.createDataFrame(pa.table(columns))), "vec", "left")  # a row for each right-hand side
        return joined.select(*self.table.columns, *(F.expr(f"coalesce(_s * ({e}), 0D)").alias(c) for e, c in zip((re, im), names, strict=True)))

    def advance(self, h: dict[int, Iterable[complex]], scale: dict[int, float], image: Callable[[DataFrame], DataFrame]) -> None:
        """Makes the next vector, and its image the new w; image gets (vec, idx, re, im) of the vecs of h."""
        n = self.n
        new = self._with(h, scale, (f"b{n}_re", f"b{n}_im")).drop("w_re", "w_im")
        w = image(new.where(F.col("vec").isin(sorted(h))).select(*self.KEYS, F.col(f"b{n}_re").alias("re"), F.col(f"b{n}_im").alias("im")))
        both = new.join(w.select(*self.KEYS, F.col("re").alias("w_re"), F.col("im").alias("w_im")), list(self.KEYS), "full")
        kept = both.select(*self.KEYS, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in both.columns[2:]))
        name, parts = f"basis_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        kept.write.bucketBy(parts, *self.KEYS).sortBy(*self.KEYS).option("path", f"{self.scratch.top}/{name}").saveAsTable(name)
        self.drop()
        self.table, self.name, self.n = self.spark.table(name), name, n + 1

    def dots(self, h: dict[int, Iterable[complex]]) -> tuple[dict[int, float], dict[int, np.ndarray]]:
        """Of w minus the sum of h b for each vec of h: its square, and <b, it> for each b."""
        sums = [F.expr(e) for j in range(self.n) for e in (f"sum(b{j}_re * v_re + b{j}_im * v_im)", f"sum(b{j}_re * v_im - b{j}_im * v_re)")]
        rows = self._with(h).where(F.col("vec").isin(sorted(h))).groupBy("vec").agg(F.expr("sum(v_re * v_re + v_im * v_im)"), *sums).collect()
        return {r[0]: r[1] for r in rows}, {r[0]: np.array(r[2::2]) + 1j * np.array(r[3::2]) for r in rows}

    def combined(self, y: dict[int, np.ndarray]) -> DataFrame:
        """vec, idx, re, im: the sum of y b for each vec of y."""
        return self._with({v: -c for v, c in y.items()}, start=False).where(F.col("vec").isin(sorted(y))).select(*self.KEYS, F.col("v_re").alias("re"), F.col("v_im").alias("im"))

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.scratch.drop(self.name)


#: Numbers of all right-hand sides in a block of _Arrays about, of one vector of the basis.
BLOCK_NUMBERS = 1 << 16


class _Arrays:
    """A cycle's vectors as _Basis has them, for images by tiles: a row holds a block of neighbouring places of all vectors as arrays.

    The rows are one table, bucketed by block; what is shuffled are blocks of the newest vector and of its image. A step
    writes the table anew in one job, with each block's part of the dots with the image. A task holds a block at a time,
    of BLOCK_NUMBERS numbers about a vector of the basis.
    """

    STATE = f"{BLOCKS}, w_re binary, w_im binary, dots binary"

    def __init__(self, scratch: Scratch, w: DataFrame, tiles: list[TiledMatrix]):
        self.scratch, self.spark, self.tiles, self.n, self.name = scratch, w.sparkSession, tiles, 0, ""
        ship(self.spark)
        self.vecs = vecs = sorted(r[0] for r in w.select("vec").distinct().collect())
        self.width = width = 1 << max(8, (BLOCK_NUMBERS // len(vecs)).bit_length() - 1)
        self.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-w.count() // (4 * width * len(vecs))))
        self.met = [t.blocks_met(width) for t in tiles]

        def pack(key, table):
            idx, vec = (np.asarray(table.column(c)) for c in ("idx", "vec"))
            ids, place = np.unique(idx, return_inverse=True)
            z = np.zeros((len(vecs), len(ids)), complex)
            np.add.at(z, (np.searchsorted(vecs, vec), place), np.asarray(table.column("re")) + 1j * np.asarray(table.column("im")))
            return _state(key[0].as_py(), ids, np.zeros((0, *z.shape), complex), z)

        self._store(w.withColumn("block", F.expr(f"cast(floor(idx / {width}D) as long)")).groupBy("block").applyInArrow(pack, self.STATE))

    def _store(self, df: DataFrame) -> None:
        name = f"arrays_{uuid.uuid4().hex}"
        df.write.bucketBy(self.parts, "block").sortBy("block").option("path", f"{self.scratch.top}/{name}").saveAsTable(name)
        self.drop()
        self.table, self.name = self.spark.table(name), name

    def _numbers(self, h: dict[int, Iterable[complex]], length: int) -> np.ndarray:
        """h's numbers by vector of the basis and right-hand side; 0 for what isn't in h."""
        out = np.zeros((length, len(self.vecs)), complex)
        for v, c in h.items():
            c = list(c)
            out[: len(c), self.vecs.index(v)] = c
        return out

    def _each(self, fn, schema: str) -> DataFrame:
        """fn of each block: its number, ids, basis and image."""
        vectors = len(self.vecs)

        def run(batches):
            for batch in batches:
                for block in _blocks(batch, vectors):
                    yield from fn(*block).to_batches()

        return self.table.mapInArrow(run, schema)

    def advance(self, h: dict[int, Iterable[complex]], scale: dict[int, float], image: Callable | None = None) -> None:
        """Makes the next vector, and its image by the tiles the new w."""
        vectors, numbers = len(self.vecs), self._numbers(h, self.n)
        factors = self._numbers({v: [c] for v, c in scale.items() if v in h}, 1).real[0]
        newest = lambda basis, w: (w - np.einsum("jv,jvi->vi", numbers, basis)) * factors[:, None]
        x = self._each(lambda b, ids, basis, w: block_table([(b, ids, newest(basis, w))]), BLOCKS)
        for k, (tile, met) in enumerate(zip(self.tiles, self.met, strict=True)):
            x = tile.block_products(add_blocks(x) if k else x, self.width, met)

        def extend(key, state, parts):
            parts = list(block_arrays(parts))
            held = next(_blocks(state, vectors), None)
            ids, basis, w = held[1:] if held else (np.zeros(0, np.int64), np.zeros((len(numbers), vectors, 0), complex), np.zeros((vectors, 0), complex))
            basis = np.concatenate([basis, newest(basis, w)[None]])
            every, w = added_blocks(parts, ids, vectors)
            if len(every) > len(ids):
                wide = np.zeros((*basis.shape[:2], len(every)), complex)
                wide[:, :, np.searchsorted(every, ids)] = basis
                basis = wide
            return _state(key[0].as_py(), every, basis, w)

        self._store(self.table.groupBy("block").cogroup(x.groupBy("block")).applyInArrow(extend, self.STATE))
        self.n += 1

    def dots(self, h: dict[int, Iterable[complex]]) -> tuple[dict[int, float], dict[int, np.ndarray]]:
        """Of w minus the sum of h b for each vec of h: its square, and <b, it> for each b."""
        numbers, n, vectors = self._numbers(h, self.n), self.n, len(self.vecs)

        def rows(found):
            j, v = (c.ravel() for c in np.indices(found.shape))
            return pa.RecordBatch.from_pydict({"j": j.astype(np.int32), "v": v.astype(np.int32), "re": found.real.ravel(), "im": found.imag.ravel()})

        def known(batches):
            found = np.zeros((n + 1, vectors), complex)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    found += np.frombuffer(raw, complex).reshape(found.shape)
            yield rows(found)

        own = lambda b, ids, basis, w: pa.Table.from_batches([rows(_dots(basis, w - np.einsum("jv,jvi->vi", numbers, basis)))])
        schema = "j int, v int, re double, im double"
        each = self._each(own, schema) if numbers.any() else self.table.select("dots").mapInArrow(known, schema)
        out = np.zeros((n + 1, vectors), complex)
        for j, v, re, im in each.groupBy("j", "v").agg(F.sum("re"), F.sum("im")).collect():
            out[j, v] = complex(re, im)
        at = {v: self.vecs.index(v) for v in h}
        return {v: out[n, k].real for v, k in at.items()}, {v: out[:n, k] for v, k in at.items()}

    def combined(self, y: dict[int, np.ndarray]) -> DataFrame:
        """vec, idx, re, im: the sum of y b for each vec of y, where a b isn't 0."""
        numbers, vecs, own = self._numbers(y, self.n), np.array(sorted(y), np.int64), [self.vecs.index(v) for v in sorted(y)]

        def rows(b, ids, basis, w):
            k, i = np.nonzero((basis != 0).any(0)[own])
            z = np.einsum("jv,jvi->vi", numbers, basis)[own][k, i]
            return pa.table({"vec": vecs[k], "idx": ids[i], "re": z.real.copy(), "im": z.imag.copy()})

        return self._each(rows, "vec long, idx long, re double, im double")

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.scratch.drop(self.name)


def _dots(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    """<b, v> of each vector of the basis by right-hand side, then the square of v."""
    return np.concatenate([np.einsum("jvi,vi->jv", basis.conj(), v), (np.abs(v) ** 2).sum(1)[None]])


def _state(block: int, ids: np.ndarray, basis: np.ndarray, w: np.ndarray) -> pa.Table:
    """A row of _Arrays.STATE. basis: by vector of the basis, right-hand side and place; w: by right-hand side and place."""
    own, image = block_table([(block, ids, basis.reshape(-1, len(ids)))]), block_table([(block, ids, w)])
    dots = pa.array([_dots(basis, w).tobytes()], pa.binary())
    return own.append_column("w_re", image.column("re")).append_column("w_im", image.column("im")).append_column("dots", dots)


def _blocks(table, vectors: int):
    """Number, ids, basis and image of each row of _Arrays.STATE."""
    for (b, ids, basis), (_, _, w) in zip(block_arrays(table), block_arrays(table, ("w_re", "w_im")), strict=True):
        yield b, ids, basis.reshape(-1, vectors, len(ids)), w


def _norms(w: DataFrame) -> dict[int, float]:
    return {r["vec"]: r["n"] for r in w.groupBy("vec").agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("n")).collect()}


class _Run:
    """What the driver knows of one right-hand side: sizes, the Hessenberg matrix of the cycle and the residuals so far."""

    def __init__(self, size: float, restart: int):
        self.size, self.restart, self.beta, self.history, self.ended = size, restart, 0.0, [], not size

    def begin(self, beta: float) -> None:
        self.beta, self.h, self.y = beta, np.zeros((self.restart + 1, self.restart), complex), np.zeros(0, complex)

    def step(self, k: int, column: Iterable[complex], rest: float, tolerance: float, most: int) -> bool:
        """Takes the k-th column and the rest's norm; True if this cycle has no further step."""
        self.h[: k + 1, k] = list(column)
        self.h[k + 1, k] = rest
        goal = self.beta * np.eye(k + 2)[0].astype(complex)
        self.y, *_ = np.linalg.lstsq(self.h[: k + 2, : k + 1], goal, rcond=None)
        self.history.append(float(np.linalg.norm(goal - self.h[: k + 2, : k + 1] @ self.y)) / self.size)
        self.ended = self.history[-1] <= tolerance or len(self.history) >= most or rest <= 1e-14 * self.beta
        return self.ended


def gmres(apply: Callable[[DataFrame], DataFrame] | TiledMatrix, b: DataFrame, precondition: Callable[[DataFrame], DataFrame] | TiledMatrix | None = None, tolerance: float = 1e-10, restart: int = 20,
          most: int = 5000, callback: Callable[[int, int, float], None] | None = None, most_vectors: int = MOST_VECTORS) -> tuple[DataFrame, dict[int, list[float]]]:
    """Solutions (vec, idx, re, im) of all right-hand sides of b, and the history of relative residuals of each vec.

    All vectors take a step together, in the same jobs; those that are done stop. The driver keeps a Hessenberg matrix
    of restart + 1 by restart for each, of most_vectors at most, more are an error; basis vectors are a table in the
    shared folder (see _Basis; _Arrays where apply and precondition are tiled matrices). precondition is applied from the left, and residuals are those of the preconditioned system. callback gets each vector,
    step and residual. A zero right-hand side has a zero solution and no history; entries of one place add.
    """
    spark, tiles = b.sparkSession, [m for m in (apply, precondition) if m is not None]
    as_arrays = all(isinstance(m, TiledMatrix) and not any(m.missing) for m in tiles)
    apply, precondition = ((lambda v, m=m: apply_matrix(m, v)) if isinstance(m, TiledMatrix) else m for m in (apply, precondition))
    scratch, left, key = Scratch(spark, "gmres"), precondition or (lambda v: v), ["vec", "idx"]
    vecs = [r[0] for r in b.select(F.col("vec").cast("long")).distinct().limit(most_vectors + 1).collect()]
    if len(vecs) > most_vectors or None in vecs:
        raise ValueError(f"right-hand sides must have a vec, and be {most_vectors} at most" if None in vecs else f"more than {most_vectors} right-hand sides")
    plain = lambda v: v.select(F.col("vec").cast("long").alias("vec"), F.col("idx").cast("long").alias("idx"), "re", "im")
    b = scratch.table(combine([(1, plain(b))], key), "b")
    rhs = scratch.table(plain(left(b)), "rhs") if precondition else b
    as_arrays = as_arrays and rhs.where("idx is null").isEmpty()
    sizes = _norms(rhs)
    runs = {v: _Run(sizes.get(v, 0.0), restart) for v in vecs}
    of = lambda df, some: df.where(F.col("vec").isin(sorted(some)))
    x, cycle = None, 0
    while active := {v for v, run in runs.items() if not run.ended}:
        r = of(rhs, active)
        if x is not None:
            r = scratch.table(combine([(1, r), (-1, plain(left(apply(of(x, active)))))], key), f"r{cycle}")
        for v, beta in _norms(r).items():
            runs[v].begin(beta)
            runs[v].ended = beta <= tolerance * runs[v].size
        on = {v for v in active if not runs[v].ended}
        if not on:
            break
        active, basis = set(on), _Arrays(scratch, of(r, on), tiles) if as_arrays else _Basis(scratch, r)
        h, scale = {v: [] for v in on}, {v: 1 / runs[v].beta for v in on}
        for k in range(restart):
            basis.advance(h, scale, lambda v: plain(left(apply(v))))
            h = {v: np.zeros(k + 1, complex) for v in on}
            for turn in range(2):  # once more where nine tenths of a vector have gone
                before, here = basis.dots(h)
                rest = {v: max(before[v] - float((np.abs(here[v]) ** 2).sum()), 0.0) for v in on}
                h = {v: h[v] + here[v] for v in on}
                if turn == 1 or all(rest[v] >= 0.01 * before[v] for v in on):
                    break
            for v in sorted(on):
                done = runs[v].step(k, h[v], rest[v] ** 0.5, tolerance, most)
                if callback:
                    callback(v, len(runs[v].history), runs[v].history[-1])
                if done:
                    on = on - {v}
            if not on:
                break
            h, scale = {v: h[v] for v in on}, {v: 1 / runs[v].h[k + 1, k].real for v in on}
        step = basis.combined({v: runs[v].y for v in active})
        x = scratch.table(combine([*([(1, x)] if x is not None else []), (1, step)], key), f"x{cycle}")
        basis.drop()
        cycle += 1
    none = b.select("vec", "idx", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return (combine([(1, x), (1, none)], key) if x is not None else none), {v: run.history for v, run in runs.items()}
