"""Removal of byte strings that occur earlier in the corpus, by doubling of position ranks.

A rank stands for the string of h bytes at a position: equal strings, equal ranks. Spark sorts positions by string at
h = length / 4 and numbers the strings in that order; positions whose rank is unique drop out. The others are sorted
again at 2 h and at 4 h bytes, by pairs of their rank and the name of the h or 2 h bytes that follow (or go before),
and get new ranks, until they are unique or `length` bytes long. Ranking every position would sort a row a byte;
instead every window of `length` bytes is represented at h by the least-hashed of the positions in it, which is the
same for equal windows, so about one position in 3 h / 2 is sorted and no repeat is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import STEP, Spans, balanced, mix, tidied
from latticework.session import Scratch, likely, ship, spare, split_by

#: Longer texts are cut into overlapping segments of so many bytes.
SEGMENT = 700_000
FLUSH = 400_000
PLACE_BITS = np.uint64(24)
#: Bounds of length: shorter strings leave no room to double, longer ones none for the hash in a context.
LEAST, MOST = 8, 4096
#: A row: gram (what is ranked next: the hash of a string, or of a rank pair), context (a hash of the row's whole
#: string, then the offset of its anchor and the number of its window starts less one, of _wide(length) bits each),
#: doc, place (tag and first start). A row with context below 0 is a repeat: the bytes from its start up to -context.
#: Rows that are still tied come out of a sort with the rank instead of the gram.
NAMES = ["gram", "context", "doc", "place"]
SCHEMA = "gram long, context long, doc long, place long"


def _wide(length: int) -> int:
    """Bits of an offset in a window."""
    return length.bit_length()


def _first(length: int) -> int:
    """Bytes of the first strings that are ranked; doubled twice they don't go beyond length."""
    return length // 4


def _segments(batch, length):
    """Lists of (doc, tag, offset, bytes): whole texts, or segments of which every window is in exactly one."""
    for i, j in balanced(batch.column(2), SEGMENT):
        own = []
        for doc, tag, text in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist(), batch.column(2).slice(i, j - i).to_pylist(), strict=True):
            raw = text.encode()
            if len(raw) >= length:
                own += [(doc, tag, k, raw[k : k + SEGMENT + length - 1]) for k in range(0, len(raw) - length + 1, SEGMENT)]
        while own:
            some, total = [], 0
            while own and (not some or total + len(own[0][3]) < 2 * SEGMENT):
                total += len(own[0][3])
                some.append(own.pop(0))
            yield some


def _first_windows(n_gram: int, gram: np.ndarray) -> np.ndarray:
    """For each i the position of the least of gram[i : i + n_gram], the leftmost of equals."""
    key = (gram >> PLACE_BITS << PLACE_BITS) | np.arange(len(gram), dtype=np.uint64)
    wide = 1
    while 2 * wide <= n_gram:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    if wide < n_gram:
        key = np.minimum(key[: len(key) - (n_gram - wide)], key[n_gram - wide :])
    return (key & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def anchors(segments, length: int):
    """Arrays gram, context, doc, place of the runs of window starts that share an anchor."""
    spans = Spans([s[3] for s in segments])
    n = len(spans.buf)
    first = _first(length)
    at = np.arange(n - first + 1)
    gram = spans.hashes(at, at + first)
    least = _first_windows(length - first + 1, gram)
    owner = np.repeat(np.arange(len(segments)), spans.size + 1)[: len(least)]
    inside = np.arange(len(least)) - spans.begin[owner]
    valid = inside + length <= spans.size[owner]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (least[:-1] != least[1:]) | ~valid[1:]
    low, high = np.flatnonzero(new), np.flatnonzero(last)
    anchor, own = least[low], owner[low]
    doc, tag, offset = (np.array([s[k] for s in segments], np.int64)[own] for k in range(3))
    return [gram[anchor].view(np.int64), _context(spans.hashes(low, high + length), anchor - low, high - low, length), doc, _place(tag, low - spans.begin[own] + offset)]


def _context(string, anchor, wide, length):
    bits = _wide(length)
    return ((string >> np.uint64(1 + 2 * bits)).astype(np.int64) << (2 * bits)) | (anchor << bits) | wide


def _place(tag, low):
    return (tag << 32) | low


def _parts(context, place, length):
    """Tag, first and last start, anchor of rows."""
    low, bits = place & 0xFFFFFFFF, _wide(length)
    return place >> 32, low, low + (context & ((1 << bits) - 1)), low + ((context >> bits) & ((1 << bits) - 1))


def _merged(doc, tag, low, high):
    """Unions of the intervals of each document."""
    order = np.lexsort((high, low, tag, doc))
    doc, tag, low, high = doc[order], tag[order], low[order], high[order]
    if not len(doc):
        return doc, tag, low, high
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(high + group * (1 << 32)) - group * (1 << 32)
    new[1:] |= low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], tag[first], low[first], np.maximum.reduceat(high, first)


def _batch(gram, context, doc, place, raw=None, more=False):
    columns = [pa.array(np.broadcast_to(x, len(doc)).astype(np.int64)) for x in (gram, context, doc, place)]
    if more:
        columns.append(pa.nulls(len(doc), pa.binary()) if raw is None else pa.array(raw, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, [*NAMES, "raw"][: len(columns)])


def _covered(doc, context, place, length, more):
    tag, low, high, _ = _parts(context, place, length)
    doc, tag, low, high = _merged(doc, tag, low, high + length)
    return _batch(doc * 31 + low, -high, doc, _place(tag, low), more=more)


def _again(first, doc, place):
    """Rows after the first of their context that begin elsewhere: those of its doc and place are the same row, from a document that comes twice."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return ~first & ((doc != doc[head]) | (place != place[head]))


def _dedupe(rows, length, raw=None):
    """Rows of a task with equal (gram, context): the first stays, the others are repeats unless they are the same row; yields batches."""
    gram, context, doc, place = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((place, doc, context, gram))
    gram, context, doc, place = (c[order] for c in (gram, context, doc, place))
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
    again = _again(first, doc, place)
    yield _batch(gram[first], context[first], doc[first], place[first], raw and [raw[k] for k in order[first]], raw is not None)
    yield _covered(doc[again], context[again], place[again], length, raw is not None)


def _ranked(batches, length, more=False):
    """Over rows sorted by gram, context, doc and place: repeats of a context are covered; first ones of a gram that has several contexts stay, with their bytes if there are any.

    Those that stay have their rank for the gram: the task's number and the gram's place in the task's order.
    """
    carry, several = None, False
    rank = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, context, doc, place = columns = [np.asarray(batch.column(k)) for k in range(4)]
        done = context < 0
        if done.any():
            yield batch.filter(pa.array(done))
        columns = [c[~done] for c in columns]
        raw = batch.column(4).filter(pa.array(~done)).to_pylist() if more else None
        if not len(columns[0]):
            continue
        if carry is not None:
            columns = [np.concatenate([[c], x]).astype(x.dtype) for c, x in zip(carry[0], columns, strict=True)]
            raw = [carry[1], *raw] if more else None
        gram, context, doc, place = columns
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        first = new.copy()
        first[1:] |= context[1:] != context[:-1]
        run = np.cumsum(new) - 1
        contexts = np.bincount(run, first)
        if carry is not None and several:
            contexts[0] += 1
        emit = first & (contexts[run] > 1)
        if carry is not None and several:
            emit[0] = False  # it went out with an earlier batch
        again = _again(first, doc, place)
        yield _covered(doc[again], context[again], place[again], length, more)
        if emit.any():
            yield _batch((rank + run)[emit], context[emit], doc[emit], place[emit], more and [raw[k] for k in np.flatnonzero(emit)] or None, more)
        rank += int(run[-1])  # the last gram may go on in the next batch
        several = bool(contexts[-1] > 1)
        k = np.flatnonzero(first)[-1]
        carry = [c[k] for c in columns], raw[k] if more else None


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with three columns more, and their names: the id (the lowest number for null), a hash that tells texts of one id apart, and the text."""
    doc, tag, text = names = spare(docs, "_doc", "_tag", "_text")
    own = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))), text: F.coalesce(F.col(text_col), F.lit(""))})
    return own.withColumn(tag, F.hash(text)), names


def repeat_spans(docs: DataFrame, scratch: Scratch, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_doc, _tag and spans (array of low, high: bytes of a `length`-byte string that also starts earlier), where there are any."""
    if not LEAST <= length <= MOST:
        raise ValueError(f"length must be {LEAST} to {MOST} bytes, not {length}")
    own, names = _placed(docs, id_col, text_col)
    src = own.select(*(F.col(n).alias(k) for n, k in zip(names, ("_doc", "_tag", "_text"), strict=True))).where(F.octet_length("_text") >= length)

    def first_ranks(batches):
        rows, n = [], 0
        for batch in batches:
            for segments in _segments(batch, length):
                rows.append(anchors(segments, length))
                n += len(rows[-1][0])
                if n > FLUSH:
                    yield from _dedupe(rows, length)
                    rows, n = [], 0
        if rows:
            yield from _dedupe(rows, length)

    def sorted_rows(df):
        return df.repartition("gram").sortWithinPartitions("gram", "context", "doc", "place")

    ranked = scratch.table(sorted_rows(src.mapInArrow(tidied(first_ranks), SCHEMA)).mapInArrow(lambda b: _ranked(b, length), SCHEMA), "ranked")
    tag_of = F.shiftright("place", 32).cast("int")
    asked = ranked.where("context >= 0").groupBy(F.col("doc").alias("_doc"), tag_of.alias("_tag")).agg(F.collect_list(F.struct("context", "place", F.col("gram").alias("rank"))).alias("asked"))

    def second_ranks(batches):
        """Rank pairs of twice the first length. Windows that reach so far to the left all have the bytes before the anchor, the others those after it."""
        first, rows, raw, n = _first(length), [], [], 0
        for batch in batches:
            for i, j in balanced(batch.column(2), SEGMENT):
                texts = [t.encode() for t in batch.column(2).slice(i, j - i).to_pylist()]
                spans, asked = Spans(texts), batch.column(3).slice(i, j - i)
                pairs = asked.flatten()
                _, low, high, anchor = _parts(np.asarray(pairs.field("context")), np.asarray(pairs.field("place")), length)
                rank = np.asarray(pairs.field("rank")).view(np.uint64)
                own = np.repeat(np.arange(j - i), np.asarray(pc.list_value_length(asked)))
                docs, tags = (np.asarray(batch.column(k).slice(i, j - i)).astype(np.int64)[own] for k in range(2))
                at = spans.begin[own]
                for side, a, b in ((0, low, np.minimum(high, anchor - first)), (1, np.maximum(low, anchor - first + 1), high)):
                    has = np.flatnonzero(a <= b)
                    a, b, mid, start = a[has], b[has], anchor[has] + at[has], at[has]
                    beside = spans.hashes(mid + first, mid + 2 * first) if side else spans.hashes(mid - first, mid)
                    rows.append([mix(mix(rank[has] * np.uint64(2) + np.uint64(side)) + beside).view(np.int64), _context(spans.hashes(start + a, start + b + length), anchor[has] - a, b - a, length), docs[has], _place(tags[has], a)])
                    raw += [texts[k][x : y + length] for k, x, y in zip(own[has].tolist(), a.tolist(), b.tolist(), strict=True)]
                    n += len(has)
                if n > FLUSH // 8:
                    yield from _dedupe(rows, length, raw)
                    rows, raw, n = [], [], 0
        if rows:
            yield from _dedupe(rows, length, raw)

    def last_ranks(batches):
        """The windows of the rows that are left, one row each: pairs of the rank and of all the window's bytes, at the row's place in it."""
        rows, n = [], 0
        for batch in batches:
            done = np.asarray(batch.column(1)) < 0
            if done.any():
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(done)) for k in range(4)], NAMES)
            some = batch.filter(pa.array(~done))
            if not some.num_rows:
                continue
            rank, context, doc, place = (np.asarray(some.column(k)) for k in range(4))
            spans = Spans(some.column(4).to_pylist())
            tag, low, high, anchor = _parts(context, place, length)
            wide = high - low + 1
            own = np.repeat(np.arange(len(low)), wide)
            inside = np.arange(len(own)) - np.repeat(np.cumsum(wide) - wide, wide)
            at = spans.begin[own] + inside
            behind = (anchor - low)[own] - inside  # where the ranked string is in the window
            pair = mix(mix(rank.view(np.uint64)[own] + behind.astype(np.uint64) * STEP) + spans.hashes(at, at + length))
            rows.append([pair.view(np.int64), _context(spans.hashes(at, at + length // 2), 0, 0, length), doc[own], _place(tag[own], low[own] + inside)])
            n += len(own)
            if n > FLUSH:
                yield from _dedupe(rows, length)
                rows, n = [], 0
        if rows:
            yield from _dedupe(rows, length)

    some = likely(src, asked, ["_doc", "_tag"]).join(asked, ["_doc", "_tag"]).select("_doc", "_tag", "_text", "asked")
    second = sorted_rows(some.mapInArrow(tidied(second_ranks), SCHEMA + ", raw binary"))
    # ranks and the next rows in one function: two in a stage would keep twice the workers
    pairs = second.mapInArrow(tidied(lambda b: last_ranks(_ranked(b, length, True))), SCHEMA)
    last = sorted_rows(pairs).mapInArrow(lambda b: _ranked(b, length), SCHEMA)
    covered = ranked.unionByName(last).where("context < 0").select(F.col("doc").alias("_doc"), tag_of.alias("_tag"), F.expr("cast(place & 4294967295 as int)").alias("low"), F.expr("cast(-context as int)").alias("high"))
    return covered.groupBy("_doc", "_tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def union(spans) -> list[tuple[int, int]]:
    """Maximal intervals, in order; touching ones are one."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def counted(docs: DataFrame) -> list[str]:
    """Names of the columns that remove_repeats adds to docs: bytes, removed bytes, removed spans, and the bytes that stay."""
    return spare(docs, "n_bytes", "n_removed", "n_spans", "kept")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of docs, and n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept (bytes that stay;
    with as_text they are a string, without those of characters that were cut in two).

    A byte goes if a `length`-byte string of its document that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Strings are judged on the input. Null texts count as empty and lose
    nothing, as do texts shorter than `length`. Null ids come before all others; texts of one id come in the order of
    a hash; rows equal in id and text are one document and get one result. An empty table gives an empty table; a length
    below LEAST or above MOST is an error. The new columns have the names
    that counted() gives, with underscores behind them where docs has a column of that name.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = scratch.table(repeat_spans(docs, scratch, length, id_col, text_col), "spans")
    scratch.drop("ranked")
    placed, (doc, tag, text) = _placed(docs, id_col, text_col)
    (found,), (n_bytes, n_removed, n_spans, kept) = spare(placed, "_spans"), counted(docs)
    spans = spans.select(F.col("_doc").alias(doc), F.col("_tag").alias(tag), F.col("spans").alias(found))
    apart, near = split_by(placed, spans, [doc, tag])
    own, zero = docs.columns, F.lit(0).cast("long")
    calm = apart.select(*own, F.octet_length(text).cast("long").alias(n_bytes), zero.alias(n_removed), zero.alias(n_spans), F.col(text).cast("string" if as_text else "binary").alias(kept))
    hit = near.join(spans, [doc, tag], "left").select(*own, text, found)
    schema = T.StructType([*docs.schema, *(T.StructField(n, T.LongType()) for n in (n_bytes, n_removed, n_spans)), T.StructField(kept, T.StringType() if as_text else T.BinaryType())])
    at = len(own)

    def cut(batches):
        for batch in batches:
            total, removed, runs, stay = [], [], [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                raw, own_spans = text.encode(), union(found)
                ends = [0, *(x for s in own_spans for x in s), len(raw)]
                stay.append(b"".join(raw[i:j] for i, j in zip(ends[0::2], ends[1::2])))
                total.append(len(raw))
                removed.append(len(raw) - len(stay[-1]))
                runs.append(len(own_spans))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(x, pa.int64()) for x in (total, removed, runs)), pa.array([k.decode("utf-8", "ignore") for k in stay], pa.string()) if as_text else pa.array(stay, pa.binary())], schema.names)

    return calm.unionByName(hit.mapInArrow(tidied(cut), schema))


def repeat_digests(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs, as remove_repeats has them."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return remove_repeats(own, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
