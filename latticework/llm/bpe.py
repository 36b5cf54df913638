"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from latticework.llm.common import balanced, documents, tidied

#: The pattern of byte-level BPE, with white space as Unicode defines it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A blank before white space or the end; elsewhere a new pretoken always begins at a blank.
NOT_A_CUT = re.compile(r" (?=\s|\Z)")
NEVER = np.int64(1 << 62)


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class PairRanks:
    """Vocabulary and merge ranks of a byte-level tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(printable_bytes())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = 1 + max([*vocab.values(), *special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(of_char[c] for c in token)
        for token, k in special.items():
            self.bytes_of[k] = token.encode()
        self.text_of = [str(k) for k in range(size)]
        self.byte_id = np.array([vocab[c] for c in printable_bytes()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.wide = np.int64(size)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys, first = np.unique(left * self.wide + right, return_index=True)
        self.keys, self.rank = np.append(keys, NEVER), np.append(first, 0).astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER if it doesn't merge or a side is missing (below 0)."""
        key = np.where((left >= 0) & (right >= 0), left * self.wide + right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)


def merge_pieces(table: PairRanks, pieces: list[bytes]) -> list[bytes]:
    """Token ids of each piece, packed. Pieces of a width are merged together, each under its own segment tree."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if p:
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
    for width, own in by_width.items():
        step = max(1, (1 << 19) // width)
        for k in range(0, len(own), step):
            some = own[k : k + step]
            for i, ids in zip(some, _merge(table, [pieces[i] for i in some], width), strict=True):
                out[i] = ids
    return out


def _merge(table: PairRanks, pieces: list[bytes], width: int) -> list[bytes]:
    """A leaf holds rank * width + position of the pair that begins at its symbol; the root is the leftmost lowest rank."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    flat = table.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    # one column more on the right: the place "after the last symbol"
    symbol = np.full((n, width + 1), -1, np.int64)
    symbol[:, :width][np.arange(width) < size[:, None]] = flat
    after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (n, width + 1)).copy()
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    place = np.arange(width)
    tree = np.full((n, 2 * width), NEVER, np.int64)
    rank = table.ranks(symbol[:, :width], symbol[:, 1:])
    tree[:, width:] = np.where(rank < NEVER, rank * width + place, NEVER)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def update(rows, at, value):
        node = at + width
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def leaf(rows, at):
        rank = table.ranks(symbol[rows, at], symbol[rows, after[rows, at]])
        return np.where(rank < NEVER, rank * width + at, NEVER)

    rows = np.flatnonzero(tree[:, 1] < NEVER)
    while len(rows):
        root = tree[rows, 1]
        at = root % width
        gone = after[rows, at]
        beyond = after[rows, gone]
        symbol[rows, at] = table.merged[root // width]
        symbol[rows, gone] = -2
        after[rows, at] = beyond
        before[rows, beyond] = at
        update(rows, gone, NEVER)
        update(rows, at, leaf(rows, at))
        left = before[rows, at]
        has = left >= 0
        if has.any():
            update(rows[has], left[has], leaf(rows[has], left[has]))
        rows = rows[tree[rows, 1] < NEVER]
    kept = symbol[:, :width] >= 0
    packed, ends = symbol[:, :width][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
    return [packed[i:j] for i, j in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts; remembers the ids of pieces that it has met."""

    def __init__(self, path: str, most_known: int):
        self.table, self.most_known = PairRanks(path), most_known
        self.pattern = regex.compile(PRETOKEN)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The text cut where a pretoken always begins; at its pretokens where blanks make that unsure."""
        parts = self.table.split_special.split(text) if self.table.split_special else [text]
        out: list[str] = []
        for part in parts:
            if part in self.table.special:
                out.append(part)
            elif NOT_A_CUT.search(part):
                out += self.pattern.findall(part)
            elif part:
                head, *rest = part.split(" ")
                if head:
                    out.append(head)
                out += [" " + x for x in rest]
        return out

    def learn(self, pieces: list[list[str]]) -> None:
        if len(self.known) > self.most_known:
            self.known.clear()
        new = [p for p in set(chain.from_iterable(pieces)) if p not in self.known]
        one = [p.isascii() and p[:1] == " " and p[1:].isalpha() for p in new]  # a blank and letters: one pretoken
        split = [[p] if o else [] if p in self.table.special else self.pattern.findall(p) for p, o in zip(new, one, strict=True)]
        distinct = list({w for words in split for w in words})
        ids = dict(zip(distinct, merge_pieces(self.table, [w.encode() for w in distinct]), strict=True))
        for p, words in zip(new, split, strict=True):
            self.known[p] = b"".join([ids[w] for w in words]) if words else self.table.special[p].to_bytes(4, "little")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit values."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(pieces)
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.table.bytes_of[k] for k in ids]).decode("utf-8", "replace")


_codecs: dict = {}


def codec(path: str, most_known: int = 600_000) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path, most_known)
    return _codecs[path]


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of each row of docs.

    Null texts count as empty: no ids, and both digests are those of the empty string. Rows keep their null or
    repeated ids; an empty table gives an empty table; other columns are ignored.
    """
    src = documents(docs, id_col, text_col)
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in balanced(texts, batch_bytes):
                n, shas, decoded = [], [], []
                for packed in own.encode([t or "" for t in texts.slice(i, j - i).to_pylist()]):
                    found = np.frombuffer(packed, "<u4").tolist()
                    n.append(len(found))
                    shas.append(hashlib.sha256(",".join([own.table.text_of[k] for k in found]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(found).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(tidied(run), schema)


def bpe_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs; nulls and empty texts have no ids."""
    src = documents(docs, id_col, text_col)
    schema = T.StructType([src.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for i, j in balanced(batch.column(1), batch_bytes):
                found = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return src.mapInArrow(tidied(run), schema)
