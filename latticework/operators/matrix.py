"""Matrices as tables (i, j, re, im) and vectors as tables (vec, idx, re, im).

Duplicates in a matrix add. All-pairs matrices are never stored: kernel_apply sums in the plan that makes the pairs.
"""

from __future__ import annotations

import copy
import io
import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from latticework.functions.kernels import distance, lookup, values
from latticework.session import Scratch, ship

RE_IM = ("re", "im")
MODES = ("none", "transpose", "conj", "adjoint")
#: An index is heavy with more entries than this and more than a HEAVY-th of all, so HEAVY at most are.
HEAVY, HEAVY_ROWS = 64, 1 << 16


def product_sum(a_re, a_im, b_re, b_im) -> list[Column]:
    return [F.sum(a_re * b_re - a_im * b_im).alias("re"), F.sum(a_re * b_im + a_im * b_re).alias("im")]


def inner_outer(mode: str) -> tuple[str, str, float]:
    """Inner and outer index of a product, and the sign of the matrix's imaginary part."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return *(("i", "j") if mode in ("transpose", "adjoint") else ("j", "i")), -1.0 if mode in ("conj", "adjoint") else 1.0


def apply_matrix(a: DataFrame | StoredMatrix | TiledMatrix, x: DataFrame, mode: str = "none") -> DataFrame:
    """op(A) x by a join on the inner index and a sum: mode none, transpose, conj or adjoint."""
    if isinstance(a, StoredMatrix | TiledMatrix):
        return a.products(x, mode).groupBy("vec", "idx").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    inner, outer, sign = inner_outer(mode)
    m, v = a.alias("m"), x.alias("v")
    joined = m.join(v, F.col(f"m.{inner}") == F.col("v.idx"))
    return joined.groupBy("v.vec", F.col(f"m.{outer}").alias("idx")).agg(*product_sum(F.col("m.re"), sign * F.col("m.im"), F.col("v.re"), F.col("v.im")))


def heavy_parts(counts: DataFrame, column: str, rows: int = HEAVY_ROWS) -> DataFrame:
    """column and parts (how many to split it into) of the heavy values of counts (column, n): HEAVY of them at most."""
    least = F.greatest(F.ceil(F.sum("n") / HEAVY), F.lit(rows)).alias("least")
    top = counts.crossJoin(F.broadcast(counts.agg(least))).where("n > least")  # one row
    return top.select(column, F.ceil(F.col("n") / F.col("least")).cast("int").alias("parts"))


class StoredMatrix:
    """A matrix written twice in the shared folder, bucketed by its columns and by its rows, duplicates added.

    A product reads the table whose buckets are those of the inner index, so that only vectors and sums are shuffled,
    however often it is done. Heavy indices are split into several parts, and their entry of a vector goes to each.
    drop() removes the tables.
    """

    def __init__(self, a: DataFrame, heavy_rows: int = HEAVY_ROWS):
        self.spark, self.name = a.sparkSession, f"matrix_{uuid.uuid4().hex}"
        self.scratch, self.heavy = Scratch(self.spark, "matrix"), {}
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entries = self.scratch.table(summed(a), "entries")
        for inner, outer in ("ij", "ji"):
            heavy = heavy_parts(entries.groupBy(inner).agg(F.count("*").alias("n")), inner, heavy_rows).toArrow()  # HEAVY rows at most
            self.heavy[inner] = self.spark.createDataFrame(heavy) if heavy.num_rows else None
            part = F.lit(0).alias("part")
            rows = entries
            if heavy.num_rows:
                part = F.coalesce(F.pmod(F.xxhash64(outer), F.col("parts")), F.lit(0)).cast("int").alias("part")
                rows = entries.join(F.broadcast(self.heavy[inner]), inner, "left")
            rows = rows.select("i", "j", "re", "im", part).repartition(buckets, inner, "part")
            rows.write.bucketBy(buckets, inner, "part").sortBy(inner, "part").option("path", f"{self.scratch.top}/by-{inner}").saveAsTable(f"{self.name}_{inner}")
        self.tables = {inner: self.spark.table(f"{self.name}_{inner}") for inner in "ij"}
        self.scratch.drop("entries")

    def entries(self, inner: str = "i") -> DataFrame:
        """i, j, re, im and part, bucketed by that index."""
        return self.tables[inner]

    def products(self, x: DataFrame, mode: str = "none") -> DataFrame:
        """vec, idx, re, im of each entry's product with op(A) x's entry, to be summed."""
        inner, outer, sign = inner_outer(mode)
        v = x.withColumn("part", F.lit(0))
        if self.heavy[inner] is not None:
            heavy = F.broadcast(self.heavy[inner].withColumnRenamed(inner, "idx"))
            v = x.join(heavy, "idx", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        # the vector is what a task hashes, never the matrix
        m, v = self.entries(inner).alias("m"), v.select("vec", "idx", "part", "re", "im").hint("shuffle_hash").alias("v")
        joined = m.join(v, (F.col(f"m.{inner}") == F.col("v.idx")) & (F.col("m.part") == F.col("v.part")))
        re, im = F.expr(f"m.re * v.re - {sign} * m.im * v.im"), F.expr(f"m.re * v.im + {sign} * m.im * v.re")
        return joined.select("v.vec", F.col(f"m.{outer}").alias("idx"), re.alias("re"), im.alias("im"))

    def drop(self) -> None:
        for inner in "ij":
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{inner}")
        self.scratch.drop("")


#: Entries of a tile of a TiledMatrix about, entries packed at a time, and cells a side at most to put tiles together from.
TILE_ENTRIES, PIECE_ENTRIES, MOST_CELLS = 1 << 21, 1 << 20, 512


def _packed(**columns) -> bytes:
    """Arrays as one binary: sorted whole numbers by their differences, doubles by a dictionary of their values."""
    out, whole = io.BytesIO(), [n for n, c in columns.items() if c.dtype.kind == "i"]
    encoding = dict.fromkeys(whole, "DELTA_BINARY_PACKED")
    pq.write_table(pa.table(columns), out, compression="zstd", use_dictionary=[n for n in columns if n not in whole], column_encoding=encoding)
    return out.getvalue()


def _unpacked(binary) -> list[np.ndarray]:
    t = pq.read_table(pa.BufferReader(binary), use_threads=False)
    return [c.to_numpy() for c in t.columns]


def _added(i: np.ndarray, j: np.ndarray, re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by row and column, duplicates added."""
    order = np.lexsort((j, i))
    i, j, re, im = i[order], j[order], re[order], im[order]
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.zeros(0, int)
    return (i, j, re, im) if len(first) == len(i) else (i[first], j[first], np.add.reduceat(re, first), np.add.reduceat(im, first))


def _pieces(batches):
    """tile and binary of each tile's entries among PIECE_ENTRIES about of a task's."""
    held, n = [], 0

    def cut():
        tile, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(tile, kind="stable")
        tile, columns = tile[order], [c[order] for c in columns]
        ends = np.r_[np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(tile)]
        for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
            body = _packed(**dict(zip(("i", "j", *RE_IM), _added(*(c[a:b] for c in columns)), strict=True)))
            yield pa.RecordBatch.from_pydict({"tile": pa.array(tile[a : a + 1], pa.int32()), "body": pa.array([body], pa.binary())})

    for batch in batches:
        if batch.num_rows:
            # a cell of its own holds missing numbers, so any number may stand for them there
            held.append([np.asarray(pc.fill_null(batch.column(c), 0)) for c in ("tile", "i", "j", *RE_IM)])
            n += batch.num_rows
        if n >= PIECE_ENTRIES:
            yield from cut()
            held, n = [], 0
    if held:
        yield from cut()


def _whole_tile(key, table):
    """A tile's pieces as one: its rows' and columns' ids, and its entries by place among them."""
    i, j, re, im = _added(*(np.concatenate(c) for c in zip(*(_unpacked(b.as_buffer()) for b in table.column("body")), strict=True)))
    (rows, p), (cols, q) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    body = _packed(p=p.astype(np.int32), q=q.astype(np.int32), re=re, im=im)
    return pa.table({"tile": key, "rows": pa.array([_packed(ids=rows)], pa.binary()), "cols": pa.array([_packed(ids=cols)], pa.binary()), "body": pa.array([body], pa.binary())})


def _cut_cells(i: np.ndarray, j: np.ndarray, n: np.ndarray, widths: tuple[int, int], most: int) -> list[tuple[np.ndarray, int]]:
    """Cells (i, j, n entries) as tiles of most entries at most: cells of each tile, and how often a cell is split each way.

    Halves of the entries are cut off along the wider side of what is left, so empty places get no tiles. Numbers -1
    (missing ids) are kept apart.
    """
    found, left = [], [k for k in (np.flatnonzero(((i < 0) == a) & ((j < 0) == b)) for a in (True, False) for b in (True, False)) if len(k)]
    while left:
        own = left.pop()
        total, spans = n[own].sum(), [int(np.ptp(c[own])) for c in (i, j)]
        if total <= most or not any(spans):
            found.append((own, 1 if total <= most else math.isqrt(-(-int(total) // most) - 1) + 1))
            continue
        side = i if (spans[0] * widths[0] >= spans[1] * widths[1] and spans[0]) or not spans[1] else j
        own = own[np.argsort(side[own], kind="stable")]
        values, sums = side[own], np.cumsum(n[own])
        at = min(max(values[np.searchsorted(sums, total / 2)], values[0] + 1), values[-1])
        cut = np.searchsorted(values, at)
        left += [own[:cut], own[cut:]]
    return found


#: Vectors beside each other, a row for each block of neighbouring places: the block's number, the sorted ids that they have
#: there, and the numbers of all vectors as arrays of doubles; im is missing where it is 0.
BLOCKS = "block long, ids binary, re binary, im binary"


def block_table(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """BLOCKS of (number, ids, numbers of the vectors by place)."""
    raw = lambda z: np.ascontiguousarray(z, float).tobytes()
    columns = zip(*((b, ids.astype(np.int64).tobytes(), raw(z.real), raw(z.imag) if z.imag.any() else None) for b, ids, z in blocks), strict=True) if blocks else [[]] * 4
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("block", "ids", *RE_IM), columns, (pa.int64(), *[pa.binary()] * 3), strict=True)})


def block_arrays(table, names: tuple[str, str] = RE_IM):
    """(number, ids, numbers of the vectors by place) of each row of BLOCKS."""
    for b, ids, re, im in zip(*(table.column(c).to_pylist() for c in ("block", "ids", *names)), strict=True):
        ids = np.frombuffer(ids, np.int64)
        z = np.frombuffer(re).reshape(len(re) // 8 // len(ids), len(ids)).astype(complex)
        if im is not None:
            z.imag = np.frombuffer(im).reshape(z.shape)
        yield b, ids, z


def added_blocks(parts: list[tuple[int, np.ndarray, np.ndarray]], ids: np.ndarray, vectors: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and those of the parts, sorted, and the sum of the parts at each."""
    every = reduce(np.union1d, (i for _, i, _ in parts), ids)
    out = np.zeros((vectors, len(every)), complex)
    for _, i, z in parts:
        out[:, np.searchsorted(every, i)] += z
    return every, out


def add_blocks(parts: DataFrame) -> DataFrame:
    """BLOCKS with the rows of a block added."""

    def add(key, table):
        held = list(block_arrays(table))
        return block_table([(key[0].as_py(), *added_blocks(held, held[0][1], len(held[0][2])))])

    return parts.groupBy("block").applyInArrow(add, BLOCKS)


class TiledMatrix:
    """A matrix written once in the shared folder, as tiles of TILE_ENTRIES entries about, duplicates added.

    A product sends each entry of a vector to the tiles that have its inner index and sums a tile's products as arrays, in
    the task that reads the tile; sums by row (or column) of a tile leave it, no product does. Tiles are cut where the
    entries are (see _cut_cells), so near indices meet few of them. Cells heavier than a tile are split by hash both ways.
    A task holds a tile and its part of all vectors. i and j are whole numbers or missing; missing values count as 0.
    drop() removes the table.
    """

    def __init__(self, a: DataFrame, most: int = TILE_ENTRIES):
        self.spark, self.name = a.sparkSession, f"tiles_{uuid.uuid4().hex}"
        self.scratch, self.factor = Scratch(self.spark, "tiles"), 1.0
        ship(self.spark)
        entries = a.select(*(F.col(c).cast("long").alias(c) for c in "ij"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RE_IM))
        n, *ends = entries.agg(F.count("*"), *(f(c) for c in "ij" for f in (F.min, F.max))).first()
        tiles = max(1, -(-n // most), min(self.spark.sparkContext.defaultParallelism, n >> 16))
        most = min(most, -(-n // tiles) or 1)
        sides = [(lo or 0, hi or 0) for lo, hi in zip(ends[::2], ends[1::2], strict=True)]
        self.widths = tuple(min((hi - lo) // min(MOST_CELLS, 4 * tiles) + 1, (1 << 63) - 1) for lo, hi in sides)
        self.least = tuple(int(math.copysign(abs(lo) // w, lo)) for (lo, _), w in zip(sides, self.widths, strict=True))
        placed = entries.withColumns({"ci": self._cell("i", 0), "cj": self._cell("j", 1)})
        cells = placed.groupBy("ci", "cj").agg(F.count("*").alias("n")).toArrow()  # (MOST_CELLS + 3)^2 rows at most
        ci, cj, counts = (np.asarray(cells.column(c)) for c in ("ci", "cj", "n"))
        rows, self.size, homes = [], 0, ([], [])
        self.missing = ([], [])
        for own, parts in _cut_cells(ci, cj, counts, self.widths, most):
            rows += [(ci[k], cj[k], self.size, parts) for k in own]
            for side, c in enumerate((ci, cj)):
                here = np.unique(c[own])
                homes[side].extend((k, self.size, parts) for k in here)
                if here[0] < 0:
                    self.missing[side].extend(range(self.size, self.size + parts * parts))
            self.size += parts * parts
        small = lambda rows, names: self.spark.createDataFrame(pa.table({c: np.array([r[k] for r in rows], np.int32) for k, c in enumerate(names)}))
        self.homes = tuple(small(h, ("cell", "base", "parts")) for h in homes)
        number = F.col("base") + F.pmod(F.xxhash64("i"), "parts") * F.col("parts") + F.pmod(F.xxhash64("j"), "parts")
        keyed = placed.join(F.broadcast(small(rows, ("ci", "cj", "base", "parts"))), ["ci", "cj"]).select(number.cast("int").alias("tile"), "i", "j", *RE_IM)
        whole = keyed.mapInArrow(_pieces, "tile int, body binary").groupBy("tile").applyInArrow(_whole_tile, "tile int, rows binary, cols binary, body binary")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        whole.write.bucketBy(buckets, "tile").sortBy("tile").option("path", f"{self.scratch.top}/tiles").saveAsTable(self.name)

    def _cell(self, column: str, side: int) -> Column:
        return F.coalesce(F.expr(f"cast({column} div {self.widths[side]} - ({self.least[side]}) as int)"), F.lit(-1))

    def products(self, x: DataFrame, mode: str = "none") -> DataFrame:
        """vec, idx, re, im of each tile's part of op(A) x, to be summed."""
        inner, _, sign = inner_outer(mode)
        side = "ij".index(inner)
        factor, kind, missing = self.factor, x.schema["vec"].dataType, frozenset(self.missing[1 - side])
        v = x.select("vec", F.col("idx").cast("long").alias("idx"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RE_IM)).where("idx is not null")
        v = v.withColumn("cell", self._cell("idx", side)).join(F.broadcast(self.homes[side]), "cell").withColumn("_r", F.explode(F.expr("sequence(0, parts - 1)")))
        own = F.pmod(F.xxhash64("idx"), "parts")
        number = F.col("base") + (F.col("_r") * F.col("parts") + own if side else own * F.col("parts") + F.col("_r"))
        v = v.select(number.cast("int").alias("tile"), "vec", "idx", *RE_IM)

        def times(tile, vectors):
            vec, idx, re, im = (vectors.column(c).combine_chunks() for c in ("vec", "idx", *RE_IM))
            out = [[], [], [], []]
            if tile.num_rows and vectors.num_rows:
                ids = [_unpacked(tile.column(c)[0].as_buffer())[0] for c in ("rows", "cols")]
                p, q, m_re, m_im = _unpacked(tile.column("body")[0].as_buffer())
                m_re = factor * m_re
                here, there, at, to = (ids[0], ids[1], p, q) if side == 0 else (ids[1], ids[0], q, p)
                idx, re, im = (np.asarray(c) for c in (idx, re, im))
                place = np.minimum(np.searchsorted(here, idx), len(here) - 1)
                hit = here[place] == idx
                codes = vec.dictionary_encode()
                number, m_im = np.asarray(codes.indices.fill_null(len(codes.dictionary))), factor * sign * m_im if m_im.any() else None
                for k in np.unique(number[hit]):
                    mine = hit & (number == k)
                    w = place[mine]
                    v_re, v_im = (np.bincount(w, c[mine], len(here)) for c in (re, im))
                    has = np.bincount(w, minlength=len(here)) > 0
                    a, b, r, s = at, to, m_re, m_im
                    if not has.all():  # places without an entry make no products
                        some = has[at]
                        a, b, r, s = at[some], to[some], m_re[some], None if m_im is None else m_im[some]
                    y_re = np.bincount(b, r * v_re[a], len(there))
                    y_im = np.bincount(b, r * v_im[a], len(there)) if v_im.any() else np.zeros(len(there))
                    if s is not None:
                        y_re -= np.bincount(b, s * v_im[a], len(there))
                        y_im += np.bincount(b, s * v_re[a], len(there))
                    met = slice(None) if has.all() else np.bincount(b, minlength=len(there)) > 0
                    one = codes.dictionary[int(k)] if k < len(codes.dictionary) else pa.scalar(None, codes.dictionary.type)
                    outer = there[met]
                    out[0].append(pa.repeat(one, len(outer)))
                    out[1].append(pa.nulls(len(outer), pa.int64()) if tile.column("tile")[0].as_py() in missing else pa.array(outer, pa.int64()))
                    out[2].append(pa.array(y_re[met], pa.float64()))
                    out[3].append(pa.array(y_im[met], pa.float64()))
            kinds = (vec.type, pa.int64(), pa.float64(), pa.float64())
            return pa.table({c: pa.chunked_array(o, t) for c, o, t in zip(("vec", "idx", *RE_IM), out, kinds, strict=True)})

        schema = StructType([StructField("vec", kind), StructField("idx", LongType()), *(StructField(c, DoubleType()) for c in RE_IM)])
        return self.spark.table(self.name).groupBy("tile").cogroup(v.groupBy("tile")).applyInArrow(times, schema)

    def blocks_met(self, width: int) -> DataFrame:
        """block, tile: the blocks (of width places) of each tile's columns, stored."""

        def run(batches):
            for batch in batches:
                for tile, cols in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    blocks = np.unique(_unpacked(cols.as_buffer())[0] // width)
                    yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "tile": pa.array(np.full(len(blocks), tile), pa.int32())})

        return self.scratch.table(self.spark.table(self.name).select("tile", "cols").mapInArrow(run, "block long, tile int"), f"met-{uuid.uuid4().hex}")

    def block_products(self, x: DataFrame, width: int, met: DataFrame) -> DataFrame:
        """BLOCKS of each tile's part of A x, to be added by block. x: BLOCKS of width places; met: blocks_met(width)."""
        factor = self.factor

        def times(tile, blocks):
            out = []
            if tile.num_rows and blocks.num_rows:
                there, here = (_unpacked(tile.column(c)[0].as_buffer())[0] for c in ("rows", "cols"))
                p, q, m_re, m_im = _unpacked(tile.column("body")[0].as_buffer())
                held = list(block_arrays(blocks))
                v = np.zeros((len(held[0][2]), len(here)), complex)
                for _, ids, z in held:
                    place = np.minimum(np.searchsorted(here, ids), len(here) - 1)
                    hit = here[place] == ids
                    v[:, place[hit]] = z[:, hit]
                y, v_re, v_im = np.zeros((len(v), len(there)), complex), v.real.copy(), v.imag.copy()
                for m, a, b, sign in ((m_re, v_re, v_im, 1.0), (m_im, v_im, v_re, -1.0)):
                    for k in range(len(v) if m.any() else 0):
                        y.real[k] += sign * factor * np.bincount(p, m * a[k][q], len(there)) if a[k].any() else 0.0
                        y.imag[k] += factor * np.bincount(p, m * b[k][q], len(there)) if b[k].any() else 0.0
                number = there // width
                cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
                out = [(int(number[a]), there[a:b], y[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return block_table(out)

        sent = x.join(met, "block").select("tile", "block", "ids", *RE_IM)
        return self.spark.table(self.name).groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(times, BLOCKS)

    def scaled(self, factor: float) -> TiledMatrix:
        """The matrix times a real number, from the same tiles."""
        out = copy.copy(self)
        out.factor = self.factor * factor
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("")


#: Points of a block of columns.
BLOCK = 2000


def block_number(rows: DataFrame, n: int) -> int:
    """Blocks of columns for n points: of BLOCK at most, and as many as there are cores if they then hold 64 or more."""
    return max(1, -(-n // BLOCK), min(rows.sparkSession.sparkContext.defaultParallelism, n // 64))


def all_pairs(rows: DataFrame, columns: DataFrame, blocks: int) -> DataFrame:
    """rows as p and columns as q (both with id), every row with every column: each row goes to every block of columns, and a task holds the columns of a block."""
    p = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).alias("p")
    q = columns.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).alias("q")
    return p.join(q, F.col("p._block") == F.col("q._block"))


def between(p: str = "p", q: str = "q") -> Column:
    return distance(*(F.col(f"{p}.{c}") for c in "xyz"), *(F.col(f"{q}.{c}") for c in "xyz"))


def kernel_pairs(rows: DataFrame, columns: DataFrame, name: str, n: Column, kappa: float = 0.0, blocks: int = 1) -> DataFrame:
    """i, j and value (struct re, im) of a kernel for all pairs of two point tables."""
    pairs = all_pairs(rows, columns, blocks).select(F.col("p.id").alias("i"), F.col("q.id").alias("j"), between().alias("d"), n.alias("n"))
    return pairs.select("i", "j", lookup(name)(F.col("d"), F.col("n"), kappa).alias("value"))


def kernel_matrix(points: DataFrame, name: str, kappa: float = 0.0, n: int | None = None, most: int = 200_000) -> DataFrame:
    """The matrix of a kernel over all pairs of points; n defaults to their number. It has n^2 rows by its meaning; more than `most` points are an error."""
    size = points.count()
    if size > most:
        raise ValueError(f"{size} points would give {size**2} entries; kernel_apply sums without making them")
    return kernel_pairs(points, points, name, F.lit(size if n is None else n), kappa, block_number(points, size)).select("i", "j", F.col("value.re").alias("re"), F.col("value.im").alias("im"))


def kernel_apply(points: DataFrame, x: DataFrame, name: str = "laplace", kappa: float = 0.0, blocks: int = 0) -> DataFrame:
    """vec, idx, re, im: x plus the kernel's sum over all other points.

    The pairs are made block by block of points, and partial sums leave every block, so no task holds more than a
    block and the shuffle carries n * blocks rows.
    """
    n = points.count()
    source = points.join(x, points["id"] == x["idx"]).select("id", "x", "y", "z", "vec", "re", "im")
    pairs = all_pairs(points, source, blocks or block_number(points, n)).where("p.id <> q.id")
    pairs = pairs.select("q.vec", F.col("p.id").alias("idx"), lookup(name)(between(), F.lit(n), kappa).alias("k"), "q.re", "q.im")
    sums = pairs.groupBy("vec", "idx").agg(*product_sum(F.col("k.re"), F.col("k.im"), F.col("re"), F.col("im")))
    return combine([(1.0, x), (1.0, sums)], ["vec", "idx"])


def combine(parts: list[tuple[complex, DataFrame]], keys: list[str]) -> DataFrame:
    """Sum of tables, each times a factor, by key."""

    def scaled(factor, df):
        c = complex(factor)
        return df.select(*keys, (c.real * F.col("re") - c.imag * F.col("im")).alias("re"), (c.real * F.col("im") + c.imag * F.col("re")).alias("im"))

    return reduce(DataFrame.unionByName, (scaled(f, d) for f, d in parts)).groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix a minus matrix b."""
    return combine([(1, a), (-1, b)], ["i", "j"])


def matrix_product(a: DataFrame, b: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Matrix a times matrix b, by a join on the inner index.

    A heavy inner index has its entries of a cut into tiles of rows and those of b into tiles of columns; each tile of
    a meets each tile of b in another task. Sums leave every task.
    """
    count = lambda m, c: heavy_parts(m.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")), "k", heavy_rows)
    scratch = Scratch(a.sparkSession, "product")
    wide, high = count(a, "j").withColumnRenamed("parts", "p"), count(b, "i").withColumnRenamed("parts", "q")
    tiles = F.broadcast(scratch.table(wide.join(high, "k", "full").select("k", F.coalesce("p", F.lit(1)).alias("p"), F.coalesce("q", F.lit(1)).alias("q")), "tiles"))  # 2 HEAVY rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    one = lambda n, c: F.coalesce(F.pmod(F.xxhash64(c), F.col(n)), F.lit(0)).cast("int")
    left = a.select("i", F.col("j").alias("k"), "re", "im").join(tiles, "k", "left").withColumn("tp", one("p", "i")).withColumn("tq", each("q"))
    right = b.select(F.col("i").alias("k"), "j", "re", "im").join(tiles, "k", "left").withColumn("tq", one("q", "j")).withColumn("tp", each("p"))
    joined = left.alias("a").join(right.alias("b"), ["k", "tp", "tq"])
    return joined.groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(*product_sum(F.col("a.re"), F.col("a.im"), F.col("b.re"), F.col("b.im")))


def apply_product(first: DataFrame, second: DataFrame, x: DataFrame, mode: str = "none") -> DataFrame:
    """The product that applies `first`, then `second`; transposed modes apply them the other way round."""
    one, two = (second, first) if mode in ("transpose", "adjoint") else (first, second)
    return apply_matrix(two, apply_matrix(one, x, mode), mode)


def apply_normal(a: DataFrame | StoredMatrix, x: DataFrame, self_adjoint: bool = False) -> DataFrame:
    """A* A x; with self_adjoint A A x, which spares the transposed join."""
    return apply_matrix(a, apply_matrix(a, x), "none" if self_adjoint else "adjoint")


def identity(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "re", "im")


def adjoint(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "re", (-F.col("im")).alias("im"))


def summed(a: DataFrame) -> DataFrame:
    """One row for each entry."""
    return a.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def frobenius(a: DataFrame) -> DataFrame:
    """fro and fro_im (of the imaginary parts) of a matrix."""
    return summed(a).agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("fro"), F.sqrt(F.sum(F.col("im") ** 2)).alias("fro_im"))


def submatrix(a: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Entries whose row is among rows (id) and column among columns (id)."""
    return a.join(rows.withColumnRenamed("id", "i"), "i", "left_semi").join(columns.withColumnRenamed("id", "j"), "j", "left_semi").select("i", "j", "re", "im")


def compared(reference: DataFrame, other: DataFrame) -> DataFrame:
    """vec, idx, re, im of reference minus other; a missing side counts as 0."""
    keys = ["vec", "idx"]
    both = reference.alias("a").join(other.alias("b"), keys, "full")
    return both.select(*keys, *((F.coalesce(F.col(f"a.{c}"), F.lit(0.0)) - F.coalesce(F.col(f"b.{c}"), F.lit(0.0))).alias(c) for c in RE_IM))


#: The factor of an update by its mode, in units of its scale.
RANK_ONE = {"none": (0.0, 0.0), "real_symmetric": (1.0, 0.0), "complex_symmetric": (1 / 5**0.5, 2 / 5**0.5), "hermitian": (1.0, 0.0), "real_nonsymmetric": (1.0, 0.0), "complex_nonsymmetric": (1 / 5**0.5, 2 / 5**0.5)}


def rank_one_factors(x: DataFrame, y: DataFrame, mode: str, scale: float) -> DataFrame:
    """idx, u_re, u_im, v_re, v_im, alpha_re, alpha_im of the update alpha u v*, u and v of unit norm.

    Symmetric modes take v = conj(u), hermitian v = u, nonsymmetric ones v from y; none has alpha 0.
    """
    if mode not in RANK_ONE:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(RANK_ONE)}")
    real = mode.startswith("real")
    a = x.select("idx", F.col("re").alias("u_re"), (F.lit(0.0) if real else F.col("im")).alias("u_im"))
    if "nonsymmetric" in mode:
        b = y.select("idx", F.col("re").alias("v_re"), (F.lit(0.0) if real else F.col("im")).alias("v_im"))
    else:
        sign = -1.0 if "symmetric" in mode else 1.0
        b = a.select("idx", F.col("u_re").alias("v_re"), (sign * F.col("u_im")).alias("v_im"))
    both = a.join(b, "idx")
    norms = both.agg(*(F.sqrt(F.sum(F.col(f"{c}_re") ** 2 + F.col(f"{c}_im") ** 2)).alias(f"n_{c}") for c in "uv"))
    scaled = both.crossJoin(F.broadcast(norms)).select("idx", *((F.col(f"{c}_{p}") / F.col(f"n_{c}")).alias(f"{c}_{p}") for c in "uv" for p in RE_IM))
    re, im = RANK_ONE[mode]
    return scaled.withColumns({"alpha_re": F.lit(scale * re), "alpha_im": F.lit(scale * im)})


def rank_one_matrix(factors: DataFrame) -> DataFrame:
    """The update as a matrix: alpha u_i conj(v_j). It has n^2 rows by its meaning."""
    return terms_matrix(factors.withColumn("term", F.lit(0).cast("long")))


def apply_rank_one(factors: DataFrame, x: DataFrame, mode: str = "none") -> DataFrame:
    """The update applied without its matrix, by one dot product a vector: mode none, transpose, conj or adjoint."""
    return apply_terms(factors.withColumn("term", F.lit(0).cast("long")), x, mode)


def perturbation_terms(left: DataFrame, right: DataFrame, alpha: DataFrame) -> DataFrame:
    """A perturbation as a table of terms: term, idx, u_re, u_im, v_re, v_im, alpha_re, alpha_im, a row for each place of either vector.

    left and right: term, idx, re, im, the vectors u and v of each term, as sparse as they are (entries that aren't
    there are 0); alpha: term, re, im. The perturbation is the sum of alpha u v* over the terms that alpha has.
    """
    sides = [df.select("term", "idx", *((F.col(p) if c == side else F.lit(0.0)).alias(f"{c}_{p}") for c in "uv" for p in RE_IM)) for side, df in (("u", left), ("v", right))]
    both = sides[0].unionByName(sides[1]).groupBy("term", "idx").agg(*(F.sum(f"{c}_{p}").alias(f"{c}_{p}") for c in "uv" for p in RE_IM))
    return both.join(alpha.select("term", *(F.col(p).alias(f"alpha_{p}") for p in RE_IM)), "term")


def only_terms(terms: DataFrame, kept: list[int] | None = None) -> DataFrame:
    """The terms of those numbers; all without numbers."""
    return terms if kept is None else terms.where(F.col("term").isin(kept))


def terms_matrix(terms: DataFrame, kept: list[int] | None = None) -> DataFrame:
    """i, j, re, im: the sum of alpha u_i conj(v_j) over the terms, paired block by block of columns."""
    own = only_terms(terms, kept)
    blocks = block_number(own, own.count())
    p = own.where("u_re <> 0 or u_im <> 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = own.where("v_re <> 0 or v_im <> 0").select("term", F.col("idx").alias("j"), F.col("v_re").alias("w_re"), F.col("v_im").alias("w_im")).withColumn("_block", F.pmod(F.xxhash64("j"), F.lit(blocks)).cast("int"))
    pairs = p.join(q, ["term", "_block"]).select(F.col("idx").alias("i"), "j", "alpha_re", "alpha_im", F.expr("u_re * w_re + u_im * w_im").alias("r"), F.expr("u_im * w_re - u_re * w_im").alias("s"))
    return pairs.groupBy("i", "j").agg(F.expr("sum(alpha_re * r - alpha_im * s)").alias("re"), F.expr("sum(alpha_re * s + alpha_im * r)").alias("im"))


def row_sums(terms: DataFrame, weight: Column | None = None, kept: list[int] | None = None) -> DataFrame:
    """idx, re, im, n: of each row of terms_matrix the sum of its entries, times a weight by column (of idx), and how many there are.

    No entry is made: the sums are the terms applied to the weights, and entries are counted by sets of terms, since a row
    meets the columns that share a term with it.
    """
    own = only_terms(terms, kept)
    sets = lambda c: own.where(f"{c}_re <> 0 or {c}_im <> 0").groupBy("idx").agg(F.sort_array(F.collect_set("term")).alias("t"))
    rows, columns = sets("u"), sets("v")
    ones = columns.select(F.lit(0).alias("vec"), "idx", (F.lit(1.0) if weight is None else weight).alias("re"), F.lit(0.0).alias("im"))
    met = rows.select("t").distinct().join(columns.groupBy(F.col("t").alias("s")).agg(F.count("*").alias("n")), F.arrays_overlap("t", "s")).groupBy("t").agg(F.sum("n").alias("n"))
    return apply_terms(own, ones).join(rows.join(met, "t"), "idx").select("idx", "re", "im", "n")


def apply_terms(terms: DataFrame, x: DataFrame, mode: str = "none", kept: list[int] | None = None) -> DataFrame:
    """op(sum of alpha u v*) x without its matrix: all dot products in one aggregate by term and vector, then one sum by place."""
    inner, _, sign = inner_outer(mode)
    own = only_terms(terms, kept)
    left, right = ("u", "v") if inner == "j" else ("v", "u")
    # none: alpha u (v* x); transpose: alpha conj(v) (u^T x); conj and adjoint conjugate all of it
    l_sign, r_sign = {"none": (1, -1), "transpose": (-1, 1), "conj": (-1, 1), "adjoint": (1, -1)}[mode]
    f = own.select("term", "idx", F.col(f"{left}_re").alias("l_re"), (l_sign * F.col(f"{left}_im")).alias("l_im"), F.col(f"{right}_re").alias("r_re"), (r_sign * F.col(f"{right}_im")).alias("r_im"), "alpha_re", (sign * F.col("alpha_im")).alias("alpha_im"))
    dots = f.where("r_re <> 0 or r_im <> 0").join(x, "idx").groupBy("term", "vec", "alpha_re", "alpha_im").agg(F.expr("sum(r_re * re - r_im * im)").alias("d_re"), F.expr("sum(r_re * im + r_im * re)").alias("d_im"))
    scaled = dots.select("term", "vec", F.expr("alpha_re * d_re - alpha_im * d_im").alias("s_re"), F.expr("alpha_re * d_im + alpha_im * d_re").alias("s_im"))
    out = f.where("l_re <> 0 or l_im <> 0").join(scaled, "term")
    return out.groupBy("vec", "idx").agg(F.expr("sum(l_re * s_re - l_im * s_im)").alias("re"), F.expr("sum(l_re * s_im + l_im * s_re)").alias("im"))


def sketch_pair(common: DataFrame, rest: DataFrame, w: DataFrame, w2: DataFrame) -> DataFrame:
    """side ('y' or 'z'), vec, idx, re, im of Y = A W and Z = A^T W' for A = common + rest, common = common^T.

    The common part is applied once to both sets of vectors.
    """
    sides = w.withColumn("side", F.lit("y")).unionByName(w2.withColumn("side", F.lit("z")))
    both = sides.withColumn("vec", F.struct("side", "vec"))
    shared = apply_matrix(common, both)
    own = apply_matrix(rest, both.where("side = 'y'").drop("side")).unionByName(apply_matrix(rest, both.where("side = 'z'").drop("side"), "transpose"))
    return combine([(1, shared), (1, own)], ["vec", "idx"]).select("vec.side", "vec.vec", "idx", "re", "im")


def dense(a: DataFrame, ids: DataFrame, operator=None) -> DataFrame:
    """i, j, re, im by applying an operator (default: the matrix a) to every basis vector; for small ids."""
    basis = ids.select(F.col("id").alias("vec"), F.col("id").alias("idx"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    out = operator(basis) if operator else apply_matrix(a, basis)
    return out.select(F.col("idx").alias("i"), F.col("vec").alias("j"), "re", "im")


#: Offset values that one broadcast holds.
MOST_VALUES = 1 << 18


def _offset_pairs(n: int, ndim: int, rows: DataFrame, columns: DataFrame, values: DataFrame, most_values: int) -> DataFrame:
    """Columns of rows as p_ and of columns as q_ (both with id, a place of the grid), every row with every column, and their value as v_.

    Pairs are made block by block of columns and looked up in the plan that makes them; a table of over most_values
    offsets is looked up in several parts, each a broadcast.
    """
    m = n + 1
    at = lambda side, a: F.expr(f"pmod({side}.id div {m ** (ndim - 1 - a)}, {m})") if a < ndim else F.lit(0)
    offsets = [F.abs(at("p", a) - at("q", a)) for a in range(3)]
    both = [c for side, df in (("p", rows), ("q", columns)) for c in (F.col(f"{side}.{x}").alias(f"{side}_{x}") for x in df.columns)]
    pairs = all_pairs(rows, columns, block_number(rows, m**ndim)).select(*both, *(d.cast("int").alias(f"_d{a}") for a, d in enumerate(offsets)))
    parts = -(-(m**ndim) // most_values)
    each = []
    for k in range(parts):
        own = values.where(F.pmod(F.xxhash64("d0", "d1", "d2"), F.lit(parts)) == k) if parts > 1 else values
        own = own.select(*(F.col(f"d{a}").cast("int").alias(f"v{a}") for a in range(3)), F.col("re").alias("v_re"), F.col("im").alias("v_im"))
        each.append(pairs.join(F.broadcast(own), [F.col(f"_d{a}") == F.col(f"v{a}") for a in range(3)]))
    return reduce(DataFrame.unionByName, each)


def _checked_grid(n: int, ndim: int, grid: DataFrame, values: DataFrame) -> None:
    """An error unless grid and values both have (n + 1)^ndim rows."""
    size = (n + 1) ** ndim
    if grid.count() != size:
        raise ValueError("the grid does not have (n + 1)^ndim points")
    if values.count() != size or values.select("d0", "d1", "d2").distinct().count() != size:
        raise ValueError("the values do not have one row for each of the (n + 1)^ndim offsets")


def offset_matrix(n: int, ndim: int, grid: DataFrame, values: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """Matrix on an (n + 1)^ndim grid whose entry depends on |index differences| alone: values (d0, d1, d2, re, im) looked up.

    It has (n + 1)^(2 ndim) rows by its meaning; apply_offsets sums without making them.
    """
    _checked_grid(n, ndim, grid, values)
    own = grid.select("id")
    return _offset_pairs(n, ndim, own, own, values, most_values).select(F.col("p_id").alias("i"), F.col("q_id").alias("j"), F.col("v_re").alias("re"), F.col("v_im").alias("im"))


LINES = "vec long, kernel boolean, c0 int, c1 int, c2 int, re double, im double"


def _along(df: DataFrame, ndim: int, axis: int, length: int, transform) -> DataFrame:
    """LINES with every line along an axis (length numbers at most) transformed; transform: dict of arrays by kernel -> the same."""
    others = [f"c{a}" for a in range(ndim) if a != axis]
    together = axis == 0  # values and kernel meet on the last axis

    def each(table):
        kernel, at = np.asarray(table.column("kernel")), np.asarray(table.column(f"c{axis}"))
        z = np.asarray(table.column("re")) + 1j * np.asarray(table.column("im"))
        lines = {}
        for k in np.unique(kernel):
            lines[bool(k)] = np.zeros(length, complex)
            np.add.at(lines[bool(k)], at[kernel == k], z[kernel == k])
        out = []
        for k, y in transform(lines).items():
            one = {"vec": table.column("vec")[0].as_py(), "kernel": k, **{c: table.column(c)[0].as_py() for c in ("c0", "c1", "c2")}}
            columns = {c: np.full(len(y), v) for c, v in one.items()} | {f"c{axis}": np.arange(len(y)), "re": y.real.copy(), "im": y.imag.copy()}
            out.append(pa.table({c: pa.array(columns[c]).cast(t) for c, t in LINE_TYPES.items()}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in LINE_TYPES.items()})

    return df.groupBy("vec", *([] if together else ["kernel"]), *others).applyInArrow(each, LINES)


LINE_TYPES = {"vec": pa.int64(), "kernel": pa.bool_(), "c0": pa.int32(), "c1": pa.int32(), "c2": pa.int32(), "re": pa.float64(), "im": pa.float64()}


def apply_offsets(n: int, ndim: int, grid: DataFrame, values: DataFrame, x: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """vec, idx, re, im: the matrix of offset_matrix times x.

    In the plane and in space it is a convolution: lines along each axis are Fourier transformed in their own groups, of
    2 (n + 1) numbers, so that work and shuffle grow with the points and not with their pairs. On a line the pairs are
    summed in the plan that makes them.
    """
    _checked_grid(n, ndim, grid, values)
    m = n + 1
    if ndim == 1:
        columns = x.select(F.col("idx").alias("id"), "vec", "re", "im")
        pairs = _offset_pairs(n, ndim, grid.select("id"), columns, values, most_values)
        return pairs.groupBy(F.col("q_vec").alias("vec"), F.col("p_id").alias("idx")).agg(*product_sum(F.col("v_re"), F.col("v_im"), F.col("q_re"), F.col("q_im")))
    ship(x.sparkSession)
    place = [F.expr(f"cast(pmod(idx div {m ** (ndim - 1 - a)}, {m}) as int)") if a < ndim else F.lit(0) for a in range(3)]
    at = [p.alias(f"c{a}") for a, p in enumerate(place)]
    own = x.select(F.col("vec").cast("long").alias("vec"), F.lit(False).alias("kernel"), *at, F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    table = values.select(F.lit(True).alias("kernel"), *(F.col(f"d{a}").cast("int").alias(f"c{a}") for a in range(3)), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    # every vector with the whole table of offsets, in four parts
    vectors = own.select("vec").distinct().withColumn("_part", F.pmod(F.xxhash64("vec"), F.lit(4)).cast("int"))
    each = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(3))))
    lines = own.unionByName(vectors.join(each, "_part").drop("_part"))

    def there(found):
        """Values with zeros behind them, offsets as an even line."""
        out = {}
        for k, z in found.items():
            wide = np.zeros(2 * m, complex)
            wide[:m] = z
            if k:
                wide[m + 1 :] = z[:0:-1]
            out[k] = np.fft.fft(wide)
        return out

    def meet(found):
        both = there(found)
        return {False: np.fft.ifft(both[False] * both[True])[:m]} if len(both) == 2 else {}

    back = lambda found: {k: np.fft.ifft(z)[:m] for k, z in found.items()}
    for a in range(ndim - 1, 0, -1):
        lines = _along(lines, ndim, a, m, there)
    lines = _along(lines, ndim, 0, m, meet)
    for a in range(1, ndim):
        lines = _along(lines, ndim, a, 2 * m, back)
    idx = sum((F.col(f"c{a}").cast("long") * m ** (ndim - 1 - a) for a in range(ndim)), F.lit(0).cast("long"))
    return lines.select(F.col("vec").cast(x.schema["vec"].dataType).alias("vec"), idx.alias("idx"), "re", "im")


#: Points of a tile of rows and of one of columns, pairs of which a task takes in turn; pairs whose arrays it holds at once.
TILE, TILE_PAIRS = 8192, 1 << 15


def tile_sums(rows: DataFrame, columns: DataFrame, fn: Callable[..., list[np.ndarray]], names: list[str], weights: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """id and a sum for each name: of each row point (id, x, y, z) over all column points, whose `weights` columns fn gets too.

    fn(d, *weights) gives an array for each name from distances (rows by columns). Points are cut into tiles by hash; each
    tile of rows meets each tile of columns in a group, as numpy arrays of TILE_PAIRS pairs at a time, and a row's sums leave
    it: n * tiles rows are shuffled and no pair is. Row ids are distinct.
    """
    ship(rows.sparkSession)
    weights = weights or []
    sizes = rows.count(), columns.count()
    parts = [max(1, -(-n // tile), min(rows.sparkSession.sparkContext.defaultParallelism, n // 64) if k == 0 else 1) for k, n in enumerate(sizes)]
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = rows.select(number(parts[0]).alias("_p"), every(parts[1]).alias("_q"), F.lit(True).alias("_row"), "id", *"xyz", *(F.lit(0.0).alias(f"_w{k}") for k in range(len(weights))))
    two = columns.select(every(parts[0]).alias("_p"), number(parts[1]).alias("_q"), F.lit(False).alias("_row"), "id", *"xyz", *(F.col(w).cast("double").alias(f"_w{k}") for k, w in enumerate(weights)))

    def each(table):
        is_row = np.asarray(table.column("_row"))
        at = np.stack([np.asarray(table.column(c), float) for c in "xyz"])
        p, q = at[:, is_row], at[:, ~is_row]
        w = [np.asarray(table.column(f"_w{k}"))[~is_row] for k in range(len(weights))]
        out = np.zeros((len(names), p.shape[1]))
        step = max(1, TILE_PAIRS // max(1, q.shape[1]))
        for a in range(0, p.shape[1], step):
            d = sum((p[c, a : a + step, None] - q[c]) ** 2 for c in range(3))
            for k, values in enumerate(fn(np.sqrt(d), *w)):
                out[k, a : a + step] = values.sum(1)
        return pa.table({"id": np.asarray(table.column("id"))[is_row], **dict(zip(names, out, strict=True))})

    sums = one.unionByName(two).groupBy("_p", "_q").applyInArrow(each, ", ".join(["id long", *(f"{n} double" for n in names)]))
    return sums.groupBy("id").agg(*(F.sum(n).alias(n) for n in names))


#: Error of a kernel's interpolation against its smallest value, and points a side of a grid at most.
FIELD_ERROR, MOST_POINTS = 4e-15, 64


def grid_points(half: float, near: float, far: float, kappa: float) -> int | None:
    """Chebyshev points a side of a cube of that half width, from which exp(i kappa d) / d is interpolated to FIELD_ERROR of its
    smallest value, for distances from near to far; None if MOST_POINTS are too few.

    On a Bernstein ellipse of parameter rho a place is off the cube by s at most, so that |d| is near - s at least and its
    imaginary part s (1 + s / near) at most; p points have an error of 4 M rho^(1 - p) / (rho - 1) along an axis for values
    up to M, and the other axes' interpolations add their Lebesgue constants.
    """
    lebesgue = 1 + 2 / math.pi * math.log(MOST_POINTS)
    best = None
    for rho in np.linspace(1.05, 30, 580):
        s = half * (rho - 1 / rho) / 2
        if s < near:
            most = 4 * (1 + lebesgue + lebesgue**2) * far / (near - s) / (rho - 1)
            p = 1 + math.ceil((math.log(most / FIELD_ERROR) + abs(kappa) * s * (1 + s / near)) / math.log(rho))
            best = p if best is None else min(p, best)
    return best if best and best <= MOST_POINTS else None


def grid_sources(targets: DataFrame, sources: DataFrame, kappa: float) -> DataFrame | None:
    """Weighted sources (id, x, y, z, w_re, w_im) on a grid of Chebyshev points that stand for `sources` at every target, to
    rounding; None where the two lie too close together, have missing places, or the grid has more than half as many points.

    A task adds its sources' weights on the whole grid, which has MOST_POINTS^3 points at most.
    """
    ends = lambda df: df.agg(*(f(c) for c in "xyz" for f in (F.min, F.max)), F.count("*"), F.count_if(F.expr("x is null or y is null or z is null"))).first()
    (*a, _, a_null), (*b, n, b_null) = ends(targets), ends(sources)
    if a_null or b_null or None in (*a, *b) or not np.isfinite([*a, *b]).all():
        return None
    (t_low, t_high), (low, high) = (np.array(e, float).reshape(3, 2).T for e in (a, b))
    near = float(np.linalg.norm(np.maximum(0, np.maximum(t_low - high, low - t_high))))
    far = float(np.linalg.norm(np.maximum(t_high - low, high - t_low)))
    middle, half = (low + high) / 2, np.maximum((high - low) / 2 * (1 + 1e-12), 1e-6 * near)
    p = grid_points(float(half.max()), near, far, kappa) if near else None
    if p is None or 2 * p**3 > n:
        return None
    order = np.arange(p)
    angle = math.pi * (order + 0.5) / p
    at_nodes = np.cos(np.outer(angle, order))

    def basis(x: np.ndarray) -> np.ndarray:
        """Each point's Lagrange polynomial at x, by x and point."""
        t = np.cos(np.outer(np.arccos(np.clip(x, -1, 1)), order))
        t[:, 0] = 0.5
        return t @ at_nodes.T * (2 / p)

    def weigh(batches):
        total = np.zeros((2, p, p * p))
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                x, y, z, re, im = (np.asarray(c, float) for c in batch.slice(i, 1024).columns)
                along = [basis((c - m) / h) for c, m, h in zip((x, y, z), middle, half, strict=True)]
                plane = (along[1][:, :, None] * along[2][:, None]).reshape(len(x), -1)
                for k, w in enumerate((re, im)):
                    if w.any():
                        total[k] += (along[0] * w[:, None]).T @ plane
        yield pa.RecordBatch.from_pydict({"id": np.arange(p**3), "w_re": total[0].ravel(), "w_im": total[1].ravel()})

    def place(batches):
        for batch in batches:
            k = np.asarray(batch.column(0))
            at = (middle[a] + half[a] * np.cos(angle[k // p ** (2 - a) % p]) for a in range(3))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **dict(zip("xyz", at, strict=True)), "w_re": batch.column(1), "w_im": batch.column(2)})

    own = sources.select(*(F.col(c).cast("double").alias(c) for c in (*"xyz", "w_re", "w_im")))
    sums = own.mapInArrow(weigh, "id long, w_re double, w_im double").groupBy("id").agg(F.sum("w_re").alias("w_re"), F.sum("w_im").alias("w_im"))
    return sums.mapInArrow(place, "id long, x double, y double, z double, w_re double, w_im double")


def field(targets: DataFrame, sources: DataFrame, name: str, kappa: float) -> DataFrame:
    """idx, re, im: sum over weighted sources (id, x, y, z, w_re, w_im) of the kernel at each target (id, x, y, z), block by block of sources.

    Where many sources lie apart from all targets, fewer ones on a grid stand for them (grid_sources).
    """
    ship(targets.sparkSession)
    value = values(name, 1, kappa)

    def products(d, w_re, w_im):
        re, im = value(d)
        return [re * w_re - im * w_im, re * w_im + im * w_re] if w_im.any() else [re * w_re, im * w_re]

    grid = grid_sources(targets, sources, kappa if name == "helmholtz" else 0.0) if name in ("laplace", "helmholtz") else None
    if grid is not None:
        sources = Scratch(targets.sparkSession, "field").table(grid, "grid")
    return tile_sums(targets, sources, products, ["re", "im"], ["w_re", "w_im"]).withColumnRenamed("id", "idx")


def coherent_sum(*fields: DataFrame) -> DataFrame:
    """idx, re, im: fields added at each place."""
    return combine([(1, f) for f in fields], ["idx"])


class Operator:
    """A linear operator with four modes, from a matrix or from anything that overrides apply()."""

    def __init__(self, matrix: DataFrame | None = None, symmetric: bool = False):
        self.matrix, self.symmetric = matrix, symmetric

    def apply(self, x: DataFrame, mode: str = "none") -> DataFrame:
        """y = op(x); conj and adjoint are the conjugate of the plain and the transposed one of the conjugate of x."""
        flip = lambda v: v.withColumn("im", -F.col("im"))
        if mode in ("conj", "adjoint"):
            return flip(self.apply(flip(x), "none" if mode == "conj" else "transpose"))
        return self.mv(x) if mode == "none" or self.symmetric else self.mv_trans(x)

    def mv(self, x: DataFrame) -> DataFrame:
        return apply_matrix(self.matrix, x)

    def mv_trans(self, x: DataFrame) -> DataFrame:
        return apply_matrix(self.matrix, x, "transpose")


class KernelOperator(Operator):
    """x plus a kernel's sum over all other points; symmetric."""

    def __init__(self, points: DataFrame, name: str = "laplace", kappa: float = 0.0):
        super().__init__(symmetric=True)
        self.points, self.name, self.kappa = points, name, kappa

    def mv(self, x):
        return kernel_apply(self.points, x, self.name, self.kappa)


REGISTRY: dict[str, type[Operator]] = {"matrix": Operator, "kernel": KernelOperator}


def register_operator(name: str, kind: type[Operator]) -> None:
    """Makes a class of operators, with mv and mv_trans, known under a name."""
    REGISTRY[name] = kind


def make_operator(name: str, *args, **kwargs) -> Operator:
    if name not in REGISTRY:
        raise ValueError(f"unknown operator {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](*args, **kwargs)


#: Types that the columns of a vector may have.
VECTOR = {"vec": ("int", "bigint"), "idx": ("int", "bigint"), "re": ("double", "float"), "im": ("double", "float")}


def checked(y: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """y if it has the columns of a vector with their types, else an error; with ids, every vector must have an entry for each id and no other."""
    kinds = dict(y.dtypes)
    wrong = [c for c, types in VECTOR.items() if kinds.get(c) not in types]
    if wrong:
        raise ValueError(f"an operator must return {list(VECTOR)}; {wrong} are missing or of another type in {y.dtypes}")
    if ids is None:
        return y
    own = ids.select(F.col("id").alias("idx")).distinct()
    n = own.count()
    sizes = y.groupBy("vec").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("k"))
    if y.join(own, "idx", "left_anti").isEmpty() and sizes.where((F.col("n") != n) | (F.col("k") != n)).isEmpty():
        return y
    raise ValueError(f"an operator must return {n} entries a vector, one for each id")
