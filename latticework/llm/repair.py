"""Faults of conversations and their cheapest repair, by a dynamic program over runs of equal symbols.

A row's symbol is its role and fault. Rows are dealt out by ranges of (conversation, order), and each Arrow batch hands
on only its runs of symbols; a conversation's runs meet in one task, as does its audit, a character a row, but never its
texts. A run is passed by powers of two of its min-plus matrix. The texts then stream past the audit into the hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import tidied
from latticework.llm.conversations import turns
from latticework.session import Scratch

WHITE = " \t\n\x0b\x0c\r"
NONE = 1 << 40
#: States: nothing yet, after system, after user, after assistant. ROLES: what a row or an insertion leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Role of a symbol (the fourth is any other) and its fault, which counts by fours.
INITIALS, FINE, TRUNCATED, REMOVED = "sua", 0, 1, 2
REPEAT, REROLE, INSERT, DELETE, KEPT_TRUNCATED = 3, 2, 2, 3, 1


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that stay, damaged by crc32(conv_id:turn) % 20 (nulls: a blank)."""
    rows = turns(conversations, " ")
    rows = rows.withColumn("f", F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("f") == REPEAT, 2).otherwise(1).cast("long").alias("copies"))


def tie(text: str = "text"):
    """16 bytes that stand for the text, and order rows of one turn and role."""
    return F.unhex(F.md5(text))


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, kind (of the role), blank, truncated, first (no equal row stands before) and copies, a row for equal rows."""
    end = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.coalesce(*(F.when(initial == x, k) for k, x in enumerate(INITIALS)), F.lit(len(INITIALS)))
    light = rows.select("conv_id", "turn", "role", tie().alias("tie"), kind.cast("int").alias("kind"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    one = light.groupBy("conv_id", "turn", "role", "tie").agg(F.first("kind").alias("kind"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.sum("copies").alias("copies"))
    same = ["conv_id", "role", "tie"]
    place = F.struct(F.col("turn").isNotNull().alias("k"), "turn")
    again = one.groupBy(*same).agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return one.join(again, same, "left").withColumn("first", F.col("least").isNull() | (place == F.col("least"))).drop("least")


PIECES = "conv_id long, mid long, kinds binary, lengths array<long>, first_kind int, last_kind int, blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long"


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2))


def pieces(batches):
    """PIECES: what each batch has of each conversation, its symbols as runs."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, kind, copies = (np.asarray(batch.column(c)) for c in ("conv_id", "kind", "copies"))
        blank, truncated, first = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "truncated", "first"))
        dated = np.asarray(batch.column("turn").is_valid())
        turn = np.asarray(batch.column("turn").fill_null(0))
        start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        end = np.append(start[1:], n)
        inside = np.concatenate([[False], conv[1:] == conv[:-1]])
        gone = blank | ~first
        symbol = kind + 4 * np.where(gone, REMOVED, np.where(truncated, TRUNCATED, FINE))
        both, times = np.stack([symbol, kind + 4 * REMOVED], 1).ravel(), np.stack([np.ones(n, np.int64), copies - 1], 1).ravel()
        owner = np.repeat(np.cumsum(~inside) - 1, 2)[times > 0]
        both, times = both[times > 0], times[times > 0]
        run = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]) | (owner[1:] != owner[:-1])]))
        lengths, kinds, of = np.add.reduceat(times, run), both[run].astype(np.uint8), owner[run]
        cut = np.searchsorted(of, np.arange(len(start) + 1))
        total = lambda x: np.add.reduceat(x.astype(np.int64), start)
        before = np.concatenate([kind[:1], kind[:-1]])
        bad = copies - 1 + (inside & ~_legal(before, kind))
        counted = dated & ~(inside & np.concatenate([[False], (turn[1:] == turn[:-1]) & dated[:-1]]))
        some = total(dated) > 0  # nulls come first, so the last turn is a number where any is
        first_turn = turn[np.minimum(end - total(dated), n - 1)]
        yield pa.RecordBatch.from_arrays([
            pa.array(conv[start]), batch.column("mid").take(pa.array(start)), pa.array([kinds[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(lengths)), pa.array(kind[start]), pa.array(kind[end - 1]), pa.array(total(blank * copies)),
            pa.array(total(~blank * (copies - first))), pa.array(total(~blank & first & truncated)), pa.array(total(bad)), pa.array(total(counted)), pa.array(first_turn, mask=~some), pa.array(turn[end - 1], mask=~some),
        ], names=[x.split()[0] for x in PIECES.split(", ")])


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(4)), NONE) for j in range(4)) for i in range(4))


def _inserts() -> tuple:
    """Cost from each state to each other by insertions alone."""
    step = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else NONE for j in range(4)) for i in range(4))
    return _product(step, _product(step, step))


def _leads(kind: int, state: int) -> int:
    """The state after a kept row of that kind, or -1."""
    if kind == 0:
        return SYSTEM if state == START else -1
    return kind + 1 if kind < 3 and NEXT[state] == kind + 1 else -1


class Repairs:
    """Costs and audits of runs of symbols; matrices, their powers and steps are kept for all conversations of a task."""

    #: Audits of at most so many conversations, of at most so many runs each, are remembered.
    KEPT, SHORT = 1 << 15, 32

    def __init__(self):
        self.inserts, self.power, self.step, self.known = _inserts(), {}, {}, {}
        self.last = tuple(min(self.inserts[s][START], self.inserts[s][ASSISTANT]) for s in range(4))

    def matrix(self, symbol: int, bit: int) -> tuple:
        """Min-plus matrix of 2 ** bit equal rows, insertions before each included."""
        if (symbol, bit) not in self.power:
            if bit:
                half = self.matrix(symbol, bit - 1)
                self.power[symbol, bit] = _product(half, half)
            else:
                kind, fault = symbol % 4, symbol // 4
                row = [[NONE] * 4 for _ in range(4)]
                for s in range(4):
                    row[s][s] = DELETE
                    if fault != REMOVED:
                        row[s][NEXT[s]] = REROLE + fault * KEPT_TRUNCATED
                        if _leads(kind, s) >= 0:
                            row[s][_leads(kind, s)] = fault * KEPT_TRUNCATED
                self.power[symbol, bit] = _product(self.inserts, tuple(map(tuple, row)))
        return self.power[symbol, bit]

    def before(self, symbol: int, bit: int, after: tuple) -> tuple:
        m = self.matrix(symbol, bit)
        return tuple(min(min(m[s][t] + after[t] for t in range(4)), NONE) for s in range(4))

    def one(self, symbol: int, after: tuple) -> tuple[tuple, int]:
        """before() of one row for costs after it less their least, again less its least, and that."""
        if (symbol, after) not in self.step:
            here = self.before(symbol, 0, after)
            self.step[symbol, after] = tuple(x - min(here) for x in here), min(here)
        return self.step[symbol, after]

    def solve(self, symbols: bytes, lengths: list[int]) -> tuple[int, str]:
        """The least cost, and of the cheapest edits the initials that are least as ASCII."""
        key = (symbols, tuple(lengths)) if len(symbols) <= self.SHORT else None
        if key in self.known:
            return self.known[key]
        ahead = [self.last]  # costs to go behind each run, last first
        for symbol, length in zip(symbols[::-1], lengths[::-1], strict=True):
            costs = ahead[-1]
            for bit in range(length.bit_length()):
                if length >> bit & 1:
                    costs = self.before(symbol, bit, costs)
            ahead.append(costs)
        state, out = START, []
        for k, (symbol, length) in enumerate(zip(symbols, lengths, strict=True)):
            behind = ahead[len(symbols) - k - 1]
            each = [tuple(x - min(behind) for x in behind)]
            for _ in range(length):
                each.append(self.one(symbol, each[-1])[0])
            kind, fault = symbol % 4, symbol // 4
            for left in range(length - 1, -1, -1):
                after, lowest = each[left], self.one(symbol, each[left])[1]
                while True:
                    want = each[left + 1][state] + lowest  # costs behind the row are less their least on both sides
                    if DELETE + after[state] == want:
                        out.append("D")
                    elif INSERT + each[left + 1][NEXT[state]] + lowest == want:
                        out.append("I")
                        state = NEXT[state]
                        continue
                    elif fault != REMOVED and (to := _leads(kind, state)) >= 0 and fault * KEPT_TRUNCATED + after[to] == want:
                        out.append("K")
                        state = to
                    else:
                        out.append("R")
                        state = NEXT[state]
                    break
        while state not in (START, ASSISTANT):
            out.append("I")
            state = NEXT[state]
        found = ahead[-1][START], "".join(out)
        if key is not None and len(self.known) < self.KEPT:
            self.known[key] = found
        return found


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(batches):
    """AUDITS of each conversation, whose pieces come in order."""
    repairs, now = Repairs(), None

    def closed(x):
        return (x["conv_id"], x["last_turn"] - x["first_turn"] + 1 - x["n_turns"] if x["first_turn"] is not None else 0, x["blank"], x["duplicate"], x["truncated"], x["illegal"], *repairs.solve(b"".join(x["kinds"]), x["lengths"]))

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.string()], strict=True)], [x.split()[0] for x in AUDITS.split(", ")])

    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            if now is None or now["conv_id"] != x["conv_id"]:
                if now is not None:
                    rows.append(closed(now))
                now = x | {"kinds": [x["kinds"]]}
                continue
            now["illegal"] += x["illegal"] + (not _legal(np.int64(now["last_kind"]), np.int64(x["first_kind"])))
            now["n_turns"] += x["n_turns"] - (x["first_turn"] is not None and x["first_turn"] == now["last_turn"])
            for c in ("blank", "duplicate", "truncated"):
                now[c] += x[c]
            now["kinds"].append(x["kinds"])
            now["lengths"].extend(x["lengths"])
            now["last_kind"] = x["last_kind"]
            if x["first_turn"] is not None:
                now["first_turn"], now["last_turn"] = x["first_turn"] if now["first_turn"] is None else now["first_turn"], x["last_turn"]
        if rows:
            yield table(rows)
    if now is not None:
        yield table([closed(now)])


def repaired(batches):
    """conv_id and repaired_sha256: each conversation's audit comes first, then its rows in order, and go into the hash one by one."""
    names = {USER: b"user:", ASSISTANT: b"assistant:"}
    conv, state, hashed, audit, at, lines = None, START, None, "", 0, 0

    def insert():
        nonlocal at, state, lines
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            hashed.update((b"\n" if lines else b"") + names[state])
            lines += 1

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        done = []
        for c, said, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if said is not None:
                if conv is not None:
                    insert()
                    done.append((conv, hashed.hexdigest()))
                conv, state, hashed, audit, at, lines = c, START, hashlib.sha256(), said, 0, 0
                continue
            for _ in range(copies):
                insert()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = NEXT[state] if edit == "R" else _leads(INITIALS.index(role[0]), state)
                hashed.update((b"\n" if lines else b"") + (names[state] if edit == "R" else role.encode() + b":") + text.encode())
                lines += 1
        if done:
            yield table(done)
    if conv is not None:
        insert()
        yield table([(conv, hashed.hexdigest())])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of the table, damaged first (see damaged).

    Rows stand in the order of turn, nulls first; of equal turns by role, then by the MD5 of the text, so that equal
    rows are adjacent. Rows without conv_id take no part; null roles and texts, and a null turn in the damage, are one
    blank. Role initials are compared as they are; a conversation without rows after the damage has zeros, an empty
    audit and the hash of an empty string. An empty table gives an empty table; other columns are ignored.
    """
    spark = conversations.sparkSession
    scratch, n = Scratch(spark, "repair"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("turn"), "role", "tie"]
    rows = damaged(conversations)
    dealt = symbols(rows).repartitionByRange(n, "conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("mid", F.monotonically_increasing_id())
    runs = dealt.select("conv_id", "turn", "kind", "blank", "truncated", "first", "copies", "mid").mapInArrow(tidied(pieces), PIECES)
    told = scratch.table(runs.repartition(n, "conv_id").sortWithinPartitions("conv_id", "mid").mapInArrow(tidied(audits), AUDITS), "audits")
    texts = rows.withColumn("tie", tie()).withColumn("audit", F.lit(None).cast("string"))
    first = told.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "long"), ("tie", "binary"))), "audit")
    both = texts.unionByName(first).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *order)
    hashes = both.select("conv_id", "audit", "role", "text", "copies").mapInArrow(tidied(repaired), "conv_id long, repaired_sha256 string")
    ids = turns(conversations).select("conv_id").distinct()
    found = ids.join(told, "conv_id", "left").join(hashes, "conv_id", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
