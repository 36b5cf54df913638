"""Packing of documents into sequences: patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.bpe import NOT_A_CUT, PairRanks
from latticework.llm.common import balanced, documents, give_back, tidied
from latticework.llm.token_counts import _tokenizer
from latticework.session import Scratch

#: The pattern of byte-level BPE, as tiktoken writes it.
TIKTOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = 2 << 20, most_known: int = 150_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token ids of each row and end_id, cut into pieces of `most` ids if longer.

    The first piece takes the remainder. Texts are cut at blanks where a pretoken always begins, and only words not met
    before are encoded, by tiktoken's merges of the same vocabulary, which are faster; first words, words with special
    strings and texts that can't be cut go through the tokenizers library. Null texts count as empty: one piece that
    holds end_id alone.
    """
    src = documents(docs, id_col, text_col)
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(n, t) for n, t in PIECE)])
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        fast, size = _byte_pairs(vocabulary)
        give_back()  # what reading the vocabulary took
        tokenizer, _ = _tokenizer(vocabulary)
        give_back()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        known, older = {}, {}  # ids of words met since the last turn-over, and of those of the turn before

        def encode(some):
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

        def learn(new, known):
            """Ids of " " + word for each new word: all of them as one text, cut where the tokens' bytes add up to a word's."""
            marked = [w for w in new if any(t in w for t in special)]
            for w, packed in zip(marked, encode([" " + w for w in marked]), strict=True):
                known[w] = packed
            new = [w for w in new if w not in known] if marked else new
            for k in range(0, len(new), 8192):
                some = [" " + w for w in new[k : k + 8192]]
                ids = np.array(fast.encode_ordinary("".join(some)) if fast else tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.cumsum(np.fromiter((len(w.encode()) for w in some), np.int64, len(some)))
                packed, cuts = ids.tobytes(), (4 * (1 + np.searchsorted(np.cumsum(size[ids]), ends))).tolist()
                known.update(zip(new[k : k + 8192], [packed[a:b] for a, b in zip([0, *cuts], cuts)]))

        for batch in batches:
            for i, j in balanced(batch.column(1), batch_bytes):
                rows = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                # head, encoded as it is, and the words after each blank; texts whose blanks are no sure cuts are all head
                parts = [(t, ()) if NOT_A_CUT.search(t) else (t.split(" ", 1)[0], t.split(" ")[1:]) for t in rows]
                if len(known) > most_known:
                    known, older = {}, known
                flat = list(chain.from_iterable(words for _, words in parts))
                ids = list(map(known.get, flat))
                lacking = [k for k, x in enumerate(ids) if x is None]
                words_lacking = {flat[k] for k in lacking}
                known.update((w, older[w]) for w in words_lacking if w in older)
                learn([w for w in words_lacking if w not in known], known)
                for k in lacking:
                    ids[k] = known[flat[k]]
                heads = encode([head for head, _ in parts])
                at = 0
                owner, out = [], []
                for k, (head, (_, words)) in enumerate(zip(heads, parts, strict=True)):
                    packed = head + b"".join(ids[at : at + len(words)]) + end
                    at += len(words)
                    n = len(packed) // 4
                    cuts = [0, n] if n <= most else [0, *range(n % most or most, n + 1, most)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i + k)
                        out.append((piece, a, b - a, zlib.crc32(memoryview(packed)[4 * a : 4 * b])))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, (n, _) in zip(columns, PIECE, strict=True))], ["doc_id", *(n for n, _ in PIECE)])

    return src.mapInArrow(tidied(run), schema)


_byte_pair: dict[str, tuple] = {}


def _byte_pairs(vocabulary: str):
    """An encoder of tiktoken for the same merges, if their ids rise with their ranks as it takes them to, and the bytes of each token."""
    if vocabulary not in _byte_pair:
        table = PairRanks(vocabulary)
        own = {b: k for k, b in enumerate(table.bytes_of) if k not in table.special.values()}
        rising = bool((np.diff(table.merged) > 0).all()) and table.merged[0] > table.byte_id.max()
        fast = tiktoken.Encoding(vocabulary, pat_str=TIKTOKEN_PATTERN, mergeable_ranks=own, special_tokens={}) if rising else None
        _byte_pair[vocabulary] = fast, np.fromiter(map(len, table.bytes_of), np.int64)
    return _byte_pair[vocabulary]


def length_patterns(room: int) -> np.ndarray:
    """All patterns of two or three lengths that fill a sequence of `room` exactly; a missing third length is 0."""
    a, b = np.triu_indices(room + 1)
    c = room - a - b
    keep = (b >= 1) & (c >= b)  # a <= b <= c
    return np.stack([a[keep], b[keep], c[keep]], 1)


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray, close: float = 1e-4) -> np.ndarray:
    """Non-negative repeat counts x that bring patterns' lengths closest to the histogram: least squares by active sets.

    A length's squared error weighs as its power of 1.5, since what is left of long pieces packs worse than short ones.
    At most as many counts as there are lengths are above 0. The inverse of the chosen patterns' product matrix is kept
    up to date as patterns come and go, and made anew every 200 changes.
    """
    n, used, scale = len(histogram), patterns > 0, max(1, int(histogram.max(initial=0)))
    h, weight = histogram / scale, (np.arange(n) / n) ** 1.5
    most = min(int((histogram > 0).sum()), len(patterns))
    inverse, at, x, z = np.zeros((most, most)), np.zeros(most, np.int64), np.zeros(most), np.zeros(most)
    usable = np.ones(len(patterns), bool)
    k = since = 0

    def shared(one, others):
        """Product of a pattern's column of the matrix with those of others."""
        return (((patterns[others][:, :, None] == patterns[one]) & used[others][:, :, None]) * weight[patterns[one]]).sum((1, 2))

    def lengths():
        out = np.bincount(patterns[at[:k]].ravel(), np.repeat(x[:k], 3), minlength=n)
        out[0] = 0
        return out

    def remove(q):
        """Takes the q-th of the k chosen patterns out, after a swap with the last."""
        for values in (at, x, z):
            values[[q, k - 1]] = values[[k - 1, q]]
        inverse[[q, k - 1], :k] = inverse[[k - 1, q], :k]
        inverse[:k, [q, k - 1]] = inverse[:k, [k - 1, q]]
        side = inverse[: k - 1, k - 1] / inverse[k - 1, k - 1]
        z[: k - 1] -= side * z[k - 1]
        inverse[: k - 1, : k - 1] -= np.outer(side, inverse[k - 1, : k - 1])

    left = h.copy()
    left[0] = 0
    for _ in range(20 * most):  # a few times `most` in practice
        gain = (weight * left)[patterns].sum(1)
        gain[~usable] = 0
        one = int(np.argmax(gain)) if k < most else 0
        if k == most or gain[one] <= close:
            break
        usable[one] = False
        by = shared(one, at[:k])
        some = np.flatnonzero(by)
        u = inverse[:k, some] @ by[some]
        apart = shared(one, np.array([one]))[0] - by[some] @ u[some]
        if apart < 1e-6:  # the chosen ones make it up
            continue
        step = ((weight * h)[patterns[one]][used[one]].sum() - by[some] @ z[some]) / apart
        z[:k] -= u * step
        inverse[:k, :k] += np.outer(u / apart, u)
        inverse[k, :k] = inverse[:k, k] = -u / apart
        inverse[k, k], z[k], at[k], x[k] = 1 / apart, step, one, 0
        k, since = k + 1, since + 1
        while len(low := np.flatnonzero(z[:k] <= 1e-12)):
            ratio = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x[:k] += ratio.min() * (z[:k] - x[:k])
            for q in low[ratio <= ratio.min()][::-1]:
                usable[at[q]] = ratio.min() > 0  # a pattern that goes as it came isn't asked again
                remove(q)
                k, since = k - 1, since + 1
        if since > 200:
            columns = np.zeros((k, n))
            np.add.at(columns, (np.repeat(np.arange(k), 3), patterns[at[:k]].ravel()), used[at[:k]].ravel())
            inverse[:k, :k] = np.linalg.inv((columns * weight) @ columns.T)
            z[:k], since = inverse[:k, :k] @ (columns @ (weight * h)), 0
        x[:k] = np.maximum(z[:k], 0)
        left = h - lengths()
        left[0] = 0
    out = np.zeros(len(patterns))
    out[at[:k]] = x[:k] * scale
    return out


def rounded(x: np.ndarray, patterns: np.ndarray, histogram: np.ndarray, least: float) -> list[tuple[list[int], int]]:
    """(lengths, repeats) of patterns: x rounded down, then up by largest remainder where that is `least` or more.

    No length is used more often than the histogram has it.
    """
    left = histogram.astype(np.int64).copy()
    whole = np.floor(x + 1e-6).astype(np.int64)
    over = x - whole
    up = np.flatnonzero((over >= least) & (over > 1e-6))
    out = []
    for k, repeat in [*((k, whole[k]) for k in np.argsort(-x, kind="stable") if whole[k]), *((k, 1) for k in up[np.argsort(-over[up], kind="stable")])]:
        lengths = [int(v) for v in patterns[k] if v]
        repeat = min([int(repeat), *(int(left[v]) // lengths.count(v) for v in lengths)])
        if repeat > 0:
            for v in lengths:
                left[v] -= repeat
            out.append((lengths, repeat))
    return out


def plan(histogram: np.ndarray, room: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): which ranks of each length go where.

    histogram[l] is the number of pieces of l ids, 1 <= l <= room. The fitted repeats are rounded up from remainders of
    0, 0.1 and so on to 1 (rounding down alone); of the plans that follow the first with the fewest sequences is taken,
    since with few pieces of a length rounding up can displace what packs better. The plan's size depends on room, not
    on the number of pieces, but for sequences with pieces of few lengths. Without pieces it has no rows.
    """
    short = histogram.astype(np.int64).copy()
    short[room] = 0
    patterns = length_patterns(room)
    patterns = patterns[((short[patterns] > 0) | (patterns == 0)).all(1)]
    x = fit_repeats(short, patterns)
    plans = [_plan(histogram, room, rounded(x, patterns, short, least)) for least in np.linspace(0, 1, 11)]
    return min(plans, key=lambda made: made[0])[1]


def _plan(histogram: np.ndarray, room: int, repeats: list[tuple[list[int], int]]) -> tuple[int, np.ndarray]:
    """The number of sequences and the rows of a plan: whole sequences, the patterns, then what they leave by best fit."""
    left = histogram.astype(np.int64).copy()
    given = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length, count, sequence, offset):
        rows.append((length, int(given[length]), count, sequence, offset))
        given[length] += count
        left[length] -= count

    if left[room]:
        place(room, int(left[room]), sequences, 0)
        sequences += rows[-1][2]
    for lengths, repeat in repeats:
        offset = 0
        for v in lengths:
            place(v, repeat, sequences, offset)
            offset += v
        sequences += repeat
    # what rounding left: longest first, each into the fullest sequences with room for it
    open_by_space: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    for v in range(room - 1, 0, -1):
        while left[v]:
            at = bisect_left(spaces, v)
            if at == len(spaces):
                space, first, count = room, sequences, int(left[v])
                sequences += count
            else:
                space = spaces[at]
                first, count = open_by_space[space].pop()
                take = min(count, int(left[v]))
                if take < count:
                    open_by_space[space].append((first + take, count - take))
                if not open_by_space[space]:
                    del open_by_space[space]
                    spaces.pop(at)
                count = take
            place(v, count, first, room - space)
            if rest := space - v:
                if rest not in open_by_space:
                    open_by_space[rest] = []
                    spaces.insert(bisect_left(spaces, rest), rest)
                open_by_space[rest].append((first, count))
    return sequences, np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, room: int, scratch: Scratch, per_salt: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset: at most `room` ids a sequence, gapless from 0. Needs columns length, 1 to room.

    Pieces of a length are numbered in salted groups of about per_salt rows, so that a length shared by many pieces
    isn't gathered; only the histogram, of at most `room` rows, comes to the driver. Rows that are equal in all
    columns are interchangeable; an empty table gives an empty table.
    """
    keys = [c for c in pieces.columns]
    salts = max(64, pieces.count() // per_salt)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counts = scratch.table(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "counts")
    histogram = np.zeros(room + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    rows = plan(histogram, room)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    numbered = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1)
    ranked = numbered.join(before, ["length", "_salt"]).select(*keys, (F.col("_rank") + F.col("_before")).alias("_rank"))
    wide = int(histogram.max(initial=0)) + 1
    first = rows[:, 0] * wide + rows[:, 1]
    schema = T.StructType([*(f for f in pieces.schema), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_rank = keys.index("length"), len(keys)

    def run(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column(at_length)), np.asarray(batch.column(at_rank))
            k = np.searchsorted(first, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], pa.array(rows[k, 3] + rank - rows[k, 1]), pa.array(rows[k, 4])], schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, room: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all rows of docs, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.table(token_pieces(docs, vocabulary, end_id, room, id_col, text_col), "pieces"), room, scratch)
