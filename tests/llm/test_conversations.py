"""The prefix trie and the repair of conversations against brute force: nulls, ties, repeats, long conversations, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from latticework.llm.prefix_trie import prefix_trie
from latticework.llm.repair import Repairs, repair

CLASH = "conv_id long, turn long, role string, text string, mid long, pid long, key binary, place long, audit string, kind int, copies long, shard long"
BLANKS = " \t\n\x0b\x0c\r"


@pytest.fixture(params=[16, 10000])
def batches(spark, request):
    """Few rows a batch, so that nodes and conversations lie in several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 5, b"k", 5, "a", 5, 5, 5) for r in rows], CLASH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    rebuilt, members, children = {}, collections.defaultdict(list), collections.defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + v[h:]
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = {k: sha(",".join(str(c) for c in members[k] if len(rebuilt[c]) == len(k))) for k in members}
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -1, len(members[k]), len(children[k]), leaves[k], saved[k], ends[k]) for k in members)


def talks(seed):
    """Short and long conversations with shared beginnings; lengths about the ends of blocks; one copied by many."""
    g, rows = random.Random(seed), []
    for c in range(45):
        n = g.choice([1, 2, 3, 5, 8, 9]) if g.random() < 0.7 else g.choice([63, 64, 65, 128, 129])
        for t in range(n):
            odd = g.random() < (0.005 if t > 2 else 0.3)
            rows.append((c if c != 7 else None, t if g.random() < 0.95 else None, ["user", "assistant", None][t % 2 if t > 9 else g.randrange(3)], g.choice(["a", "b", "é", None]) if odd else "x" * (t % 3)))
    return rows + [(c, t, "user", f"same{t}" if (c, t) != (120, 100) else "odd") for c in range(100, 125) for t in range(130)] + rows[:9]


@pytest.mark.parametrize("seed", [4, 5])
def test_trie(spark, batches, seed):
    rows = talks(seed)
    got = sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie(frame(spark, rows)).collect())
    assert got == brute_trie(rows)


def test_trie_of_turnless_and_empty(spark):
    few = [(c, 0, "user", "x") for c in (1, 6, 11)]  # without the conversations 0, 5 and 10 their first turns are none
    got = sorted(tuple(r) for r in prefix_trie(frame(spark, few)).collect())
    assert got == [(1, 0, None, 3, 0, 1, 0, sha("1,6,11"))]
    assert prefix_trie(frame(spark, [])).count() == 0 and prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def cheapest(rows):
    """Cost and audit: a plain program over row and state that keeps whole strings. rows: initial, must go, truncated."""
    following, best = {"": "u", "s": "u", "u": "a", "a": "u"}, [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        here = best[i]

        def offer(state, cost, audit, here=here):
            if state not in here or (cost, audit) < here[state]:
                here[state] = (cost, audit)

        if i == len(rows):
            offer("", 0, "")
            offer("a", 0, "")
        else:
            initial, gone, truncated = rows[i]
            for s, to in following.items():
                after = best[i + 1]
                if s in after:
                    offer(s, after[s][0] + 3, "D" + after[s][1])
                kept = "s" if (initial, s) == ("s", "") else to if initial == to else None
                if not gone and kept in after:
                    offer(s, after[kept][0] + truncated, "K" + after[kept][1])
                if not gone and to in after:
                    offer(s, after[to][0] + 2 + truncated, "R" + after[to][1])
        for _ in range(4):
            for s, to in following.items():
                if to in here:
                    offer(s, here[to][0] + 2, "I" + here[to][1])
    return best[0][""]


def brute_repair(rows):
    talk, ids = collections.defaultdict(list), {r[0] for r in rows if r[0] is not None}
    for c, t, r, x in rows:
        f = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if c is None or f == 0:
            continue
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
        talk[c] += [(t is not None, t or 0, "user" if f == 4 else r, hashlib.md5(x.encode()).digest(), x)] * (2 if f == 3 else 1)
    out = []
    for c in ids:
        own, seen, symbols, counts = sorted(talk[c]), set(), [], [0, 0, 0]
        dates = [x[1] for x in own if x[0]]
        for _, _, role, _, text in own:
            bare = text.strip(BLANKS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            symbols.append((role[:1], fault in (0, 1), int(fault == 2)))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        cost, audit = cheapest(symbols)
        lines, state, k, names = [], "", 0, {"u": "user", "a": "assistant"}
        for edit in audit:
            if edit == "I":
                state = "a" if state == "u" else "u"
                lines.append(names[state] + ":")
                continue
            role, text, k = own[k][2], own[k][4], k + 1
            if edit != "D":
                state = role[0] if edit == "K" else "a" if state == "u" else "u"
                lines.append((role if edit == "K" else names[state]) + ":" + text)
        out.append((c, max(dates) - min(dates) + 1 - len(set(dates)) if dates else 0, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, batches, seed):
    g, rows = random.Random(seed), []
    for c in range(150):
        for t in range(g.choice([1, 1, 2, 3, 4, 5, 8, 30])):
            odd = g.random() < 0.5
            role = g.choice(["user", "assistant", "system", "tool", "", None]) if odd else ["user", "assistant"][t % 2]
            text = g.choice(["a.", "b", "é!", "", "  ", "\n", " x. \n", None]) if g.random() < 0.4 else f"t{t}."
            rows.append((c if c != 7 else None, t if g.random() < 0.9 else g.choice([None, t - 1]), role, text))
    rows += [(500, t, "user", "again.") for t in range(300)] + [(501, None, "user", "no date.")] * 3 + g.sample(rows, 20)
    assert sorted(tuple(r) for r in repair(frame(spark, rows)).collect()) == brute_repair(rows)


def test_conversation_that_is_dropped_as_a_whole(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in repair(frame(spark, [(gone, 0, "user", "x.")])).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert repair(frame(spark, [])).count() == 0


def test_runs_and_rows_cost_the_same():
    """Powers of a run's matrix against the plain program, a row after the other."""
    g, repairs = random.Random(3), Repairs()
    for _ in range(200):
        runs = [(g.randrange(12), g.choice([1, 1, 2, 3, 9])) for _ in range(g.randrange(6))]
        rows = [("sua?"[s % 4], s // 4 == 2, int(s // 4 == 1)) for s, n in runs for _ in range(n)]
        assert repairs.solve(bytes(s for s, _ in runs), [n for _, n in runs]) == cheapest(rows)
