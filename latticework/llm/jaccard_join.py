"""Jaccard similarity classes of word-shingle sets, by R-trees over count vectors and exact checks.

Every set is a point: its shingles are hashed into groups, and the point has the count of each group. The overlap of
two sets is at most the sum of the smaller counts, and so is that of a set with any set inside a box of an R-tree.
One tree over the corpus would not prune, since points of unlike texts of a size lie close together; so the points
are dealt out to cells, sets that share a shingle of their prefix, as linked sets always do, and every cell has its
own trees. All candidate pairs come from the trees.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import balanced, documents, mix, shingles, tidied
from latticework.llm.components import components
from latticework.session import Scratch, likely, spare, split_by

#: A set of n shingles has 2^bits groups: sixteen for each shingle while that is 2^FINE_BITS at most, and one at least
#: up to 2^MOST_BITS.
LEAST_BITS, FINE_BITS, MOST_BITS = 9, 12, 14
#: A shingle in one of so many documents is put last in the order of prefixes.
COMMON = 4000
#: Points in a tree; more are dealt out to blocks, each pair of which has its own tree.
BLOCK = 2048
LEAF = 24
#: Bytes of text whose shingles a worker hashes at once.
CHUNK = 1 << 19


def _rows(batch, i, j):
    return [t.encode().lower() if t else b"" for t in batch.column(1).slice(i, j - i).to_pylist()]


def common_shingles(docs: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """Hashes of shingles in one of COMMON documents or more, at most COMMON times the mean set size; may miss some,
    which costs time alone."""

    def run(batches):
        kept, counts, n_docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                found, _ = shingles(_rows(batch, i, j), width)
                n_docs += j - i
                some, n = np.unique(found, return_counts=True)
                kept, at = np.unique(np.concatenate([kept, some]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(kept)).astype(np.int64)
                if len(kept) > 200_000:
                    kept, counts = kept[counts > 1], counts[counts > 1]
        keep = counts >= max(4, n_docs // (COMMON // 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept[keep].view(np.int64), 0)), pa.array(np.append(counts[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), n_docs))], ["shingle", "n", "docs"])

    local = scratch.table(docs.mapInArrow(tidied(run), "shingle long, n long, docs long"), "common")
    total = local.agg(F.sum("docs")).first()[0] or 0
    hot = local.where("docs = 0").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, total // COMMON)).select("shingle")
    return np.sort(np.asarray(hot.toArrow().column(0).to_numpy()).astype(np.int64).view(np.uint64))


def packed_counts(counts: np.ndarray) -> bytes:
    """Bytes of a count, then the counts, in as few bytes each as hold them all, compressed."""
    size = 1 if counts.max(initial=0) < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + zlib.compress(counts.astype(f"<u{size}").tobytes(), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(raw)[1:]), f"<u{raw[0]}")


def group_bits(n: np.ndarray) -> np.ndarray:
    bits = np.ceil(np.log2(np.maximum(n, 1)))
    return np.clip(np.maximum(np.minimum(bits + 4, FINE_BITS), bits), LEAST_BITS, MOST_BITS).astype(int)


def points(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, s1, s2 (a 128-bit signature of the set), n (its size), point (counts of the groups), prefix (hashes).

    The prefix holds the first n - ceil(n * percent / 100) + 1 shingles, uncommon ones first; two sets of that
    similarity always share a shingle of their prefixes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("s1", "s2", "n")), T.StructField("point", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches):
        common = np.append(shared.value, np.uint64(0))
        for batch in batches:
            for i, j in balanced(batch.column(1), CHUNK):
                k = j - i
                h, doc = shingles(_rows(batch, i, j), width)
                n = np.bincount(doc, minlength=k)
                starts, has = np.cumsum(n) - n, np.flatnonzero(n)
                first = starts[has]
                signs = np.zeros((2, k), np.uint64)
                if len(has):
                    signs[0, has] = np.add.reduceat(mix(h), first)
                    signs[1, has] = np.add.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), first)
                point = [packed_counts(np.bincount((h[a : a + c] >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b)) for a, c, b in zip(starts.tolist(), n.tolist(), group_bits(n).tolist(), strict=True)]
                late = common[np.minimum(np.searchsorted(common[:-1], h), len(common) - 1)] == h
                order = np.lexsort((h, late, doc))
                place = np.arange(len(h)) - np.repeat(first, n[has])
                taken = n - (n * percent + 99) // 100 + 1
                keep = place < taken[doc]  # doc is in order, so it stays as it is
                chosen, sizes = h[order][keep], np.bincount(doc[keep], minlength=k)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(chosen.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, k), pa.array(signs[0].view(np.int64)), pa.array(signs[1].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(point, pa.binary()), prefix], schema.names)

    return docs.mapInArrow(tidied(run), schema)


def shared_keys(keys: DataFrame, percent: int) -> DataFrame:
    """Distinct rows (key, node) of the keys that several nodes of near sizes have, and a few others. keys: key, n, node.

    Rows are dealt out by ranges of (key, n, node), so a key of very many nodes is spread over tasks. A node whose
    neighbours in the order of sizes are too small or too large for a link has no link by this key; the first and the
    last row of a task are kept as their neighbours are unknown there.
    """

    def run(batches):
        last, before = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
            rows = rows if last is None else np.concatenate([last, rows], 1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
            key, n, node = rows = rows[:, new]
            near = np.zeros(len(key) + 1, bool)
            near[0], near[1:-1] = before, (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = (near[:-1] | near[1:])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(node[:-1][keep])], ["key", "node"])
            last, before = rows[:, -1:], bool(near[len(key) - 1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[2])], ["key", "node"])

    return keys.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node").mapInArrow(run, "key long, node long")


def cells_of(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """cell, m, node: the sets of a cell, m of them, two at least.

    A cell has all sets that share a key whose least node gives the cell its number. Near copies share most of their
    keys, and these keys mostly the least node, so a set is in few cells; and sets that share a key share a cell.
    """
    least = shared.groupBy("key").agg(F.min("node").alias("cell"), F.count("*").alias("n")).where("n >= 2").drop("n")
    held = scratch.table(shared.join(least, "key").select("cell", "node").distinct(), "held")
    return held.join(held.groupBy("cell").agg(F.count("*").alias("m")), "cell").select("cell", "m", "node")


def needed(n_a, n_b, percent):
    """The overlap from which sets of these sizes are linked."""
    return -(-(percent * (n_a + n_b)) // (100 + percent))


def tree_pairs(one, two, percent: int):
    """Index pairs, and the bounds of their overlap, of points of different components that may be linked, by bulk-loaded R-trees joined with each other.

    one, two: n, point (counts of the groups, a row each) and comp; the pairs of one's points if two is None. A box
    of a tree holds the highest count of each group, the smallest and largest size, and whether it has points of one
    component alone.
    """

    def build(side, own):
        n, point, comp = side
        low, high = point[own].min(0), point[own].max(0)
        box = {"own": own, "high": high, "n": int(n[own].min()), "n_high": int(n[own].max()), "one": comp[own[0]] if (comp[own] == comp[own[0]]).all() else None, "sub": ()}
        if len(own) > LEAF:
            wide = (high - low).argmax() if (high != low).any() else None
            order = own[np.argsort(n[own] if box["n_high"] * percent > box["n"] * 100 or wide is None else point[own, wide], kind="stable")]
            box["sub"] = (build(side, order[: len(own) // 2]), build(side, order[len(own) // 2 :]))
        return box

    def meet(x, y):
        if x["one"] is not None and x["one"] == y["one"]:
            return
        if 100 * x["n_high"] < percent * y["n"] or 100 * y["n_high"] < percent * x["n"] or int(np.minimum(x["high"], y["high"]).sum(dtype=np.int64)) < needed(x["n"], y["n"], percent):
            return
        if x is y and x["sub"]:
            left, right = x["sub"]
            stack.extend([(left, left), (right, right), (left, right)])
        elif x["sub"] and (not y["sub"] or len(x["own"]) >= len(y["own"])):
            stack.extend((s, y) for s in x["sub"])
        elif y["sub"]:
            stack.extend((x, s) for s in y["sub"])
        else:
            p, q = x["own"], y["own"]
            step = max(1, (1 << 22) // (len(q) * one[1].shape[1]))
            over = np.concatenate([np.minimum(one[1][p[k : k + step], None], other[1][None, q]).sum(2, dtype=np.uint32).astype(np.int64) for k in range(0, len(p), step)])
            ok = (over >= needed(one[0][p][:, None], other[0][q][None], percent)) & (one[2][p][:, None] != other[2][q][None])
            if two is None:
                ok &= (p[:, None] < q[None]) if x is y else True
            i, j = np.nonzero(ok)
            out.append((p[i], q[j], over[i, j]))

    other = one if two is None else two
    out: list = [(np.zeros(0, np.int64),) * 3]
    if len(one[0]) and len(other[0]):
        root = build(one, np.arange(len(one[0])))
        stack = [(root, root if two is None else build(two, np.arange(len(two[0]))))]
        while stack:
            meet(*stack.pop())
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _narrow(counts: np.ndarray) -> np.ndarray:
    """counts in as few bytes each as hold them all."""
    top = counts.max(initial=0)
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts of fewer groups: neighbouring ones added up."""
    return counts if counts.shape[1] <= groups else _narrow(counts.reshape(len(counts), groups, counts.shape[1] // groups).sum(2, dtype=np.uint32))


def cell_pairs(n: np.ndarray, raw: list[bytes], comp: np.ndarray, side: np.ndarray, percent: int):
    """Pairs of a cell's points, as tree_pairs has them. side: 0 and 1 for two blocks that are joined, all 0 for one.

    The trees take about one group a shingle; the pairs that they find are bounded again by all groups that both
    points have. Where points of different groups meet, neighbouring groups of the finer are added up, which leaves a
    bound.
    """
    counts = [unpacked_counts(r) for r in raw]
    groups, cross = np.fromiter(map(len, counts), np.int64, len(counts)), len(np.unique(side)) > 1
    levels = {g: _narrow(np.stack([counts[k] for k in np.flatnonzero(groups == g)])) for g in np.unique(groups).tolist()}
    out = [(np.zeros(0, np.int64),) * 3]
    for g in levels:
        for h in (h for h in levels if h >= g):
            a, b = np.flatnonzero(groups == g), np.flatnonzero(groups == h)
            if 100 * n[a].max() < percent * n[b].min() or 100 * n[b].max() < percent * n[a].min():
                continue
            p, q = levels[g], _folded(levels[h], g)
            coarse = min(g, 1 << max(5, int(n[a].max() - 1).bit_length()))
            for s, t in ([(0, 1)] if g == h else [(0, 1), (1, 0)]) if cross else [(0, 0)]:
                x, y = np.flatnonzero(side[a] == s), np.flatnonzero(side[b] == t)
                two = None if g == h and not cross else (n[b][y], _folded(q[y], coarse), comp[b][y])
                i, j, over = tree_pairs((n[a][x], _folded(p[x], coarse), comp[a][x]), two, percent)
                if coarse < g and len(i):
                    step = max(1, (1 << 23) // g)
                    over = np.concatenate([np.minimum(p[x[i[k : k + step]]], q[y[j[k : k + step]]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)])
                    keep = over >= needed(n[a][x[i]], n[b][y[j]], percent)
                    i, j, over = i[keep], j[keep], over[keep]
                out.append((a[x[i]], b[y[j]], over))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def best_links(i: np.ndarray, j: np.ndarray, spare: np.ndarray, size: int) -> np.ndarray:
    """Of the pairs each point's best one, by the bound that most exceeds the need; of equal ones that with the point that has more partners."""
    degree = np.bincount(i, minlength=size) + np.bincount(j, minlength=size)
    own, other, pair = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((other, -degree[other], -spare[pair], own))
    new = np.ones(len(order), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    return np.unique(pair[order[new]])


def candidates(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """a, b, over: pairs of nodes of a cell, of different components, that the trees' bounds allow, and the bound.

    members: cell, m, node, n, comp, point. Cells of more than BLOCK nodes are dealt out to blocks, all pairs of which
    meet. With best, each node has the pair of its best bound only (best_links), in each pair of blocks and then over all.
    """
    dealt = members.withColumn("blocks", F.expr(f"cast(ceil(m / {BLOCK}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    runs = "transform(sequence(0, blocks - 1), o -> named_struct('i', least(block, o), 'j', greatest(block, o), 'side', if(block <= o, 0, 1)))"
    dealt = dealt.select("cell", F.explode(F.expr(runs)).alias("r"), "node", "n", "comp", "point")
    ordered = dealt.select("cell", "r.i", "r.j", "r.side", "node", "n", "comp", "point").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def join(held):
        side, node, n, comp = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (3, 4, 5, 6))
        if (comp == comp[0]).all():
            return None
        i, j, over = cell_pairs(n, [x for b in held for x in b.column(7).to_pylist()], comp, side, percent)
        exceeds = over - needed(n[i], n[j], percent)
        if best:
            k = best_links(i, j, exceeds, len(n))
            i, j, over, exceeds = i[k], j[k], over[k], exceeds[k]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(over), pa.array(exceeds)], ["a", "b", "over", "exceeds"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
            cuts = [0, *(1 + np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0))).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                name = tuple(names[:, i])
                if name != now and held:
                    if (out := join(held)) is not None:
                        yield out
                    held = []
                now = name
                held.append(batch.slice(i, j - i))
        if held and (out := join(held)) is not None:
            yield out

    found = ordered.mapInArrow(tidied(run), "a long, b long, over long, exceeds long")
    if best:
        each = found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "over", "exceeds")
        top = each.groupBy("x.a").agg(F.max(F.struct("exceeds", -F.col("x.b"), F.col("x.b").alias("b"), "over")).alias("t"))
        found = top.select(F.least("a", "t.b").alias("a"), F.greatest("a", "t.b").alias("b"), "t.over")
    return found.groupBy("a", "b").agg(F.max("over").alias("over"))


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the documents whose ids are in pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return likely(docs.withColumnRenamed("doc_id", "node"), nodes, ["node"], 1 << 20).join(nodes, "node", "left_semi").select("node", "text")


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets are linked, counted exactly from their texts, which are smaller than sets of hashes.

    The text of a goes, once for each sixteenth of its partners, where those of its partners go.
    """
    salt = F.expr("cast(pmod(xxhash64(b), 16) as int)").alias("salt")
    asked = pairs.select(F.col("a").alias("node"), "a", salt, F.lit(0).alias("role")).distinct().unionByName(pairs.select(F.col("b").alias("node"), "a", salt, F.lit(1).alias("role")))
    routed = texts.join(asked, "node").select("a", "salt", "role", "node", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        now, own = None, []
        for batch in batches:
            for i, j in balanced(batch.column(4), CHUNK):
                some = batch.slice(i, j - i)
                h, doc = shingles([t.encode().lower() if t else b"" for t in some.column(4).to_pylist()], width)
                sets = np.split(h, np.cumsum(np.bincount(doc, minlength=j - i))[:-1])
                found = []
                for a, salt, role, node, x in zip(*(some.column(k).to_pylist() for k in range(4)), sets, strict=True):
                    if (a, salt) != now:
                        now, own = (a, salt), []
                    if role == 0:
                        own.append(x)
                        continue
                    both = [len(np.intersect1d(x, y, assume_unique=True)) for y in own]
                    if any(k > 0 and 100 * k >= percent * (len(x) + len(y) - k) for k, y in zip(both, own, strict=True)):
                        found.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

    return routed.mapInArrow(tidied(run), "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a text of fewer than `width` words is one
    shingle. Documents are linked when 100 * |intersection| >= percent * |union|; component_id is the smallest doc_id
    reachable. Null and empty texts have no shingle and are linked with nothing: their own id. Rows with one id are
    one document, linked as any of its texts is. Null ids are linked with nothing: component_id null. An empty table
    gives an empty table; other columns are ignored.

    1. Equal sets fall together by signature. 2. Each set is looked up in the trees of its largest cell, and is checked
    with the one set there whose bound is best. 3. Where a cell then has several components, its trees give all pairs
    across components, which are checked best bound first until none is left between different components. So no link
    that matters for a component goes unchecked, and a group of near copies costs a check a member and not one a pair.
    """
    src = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scratch = Scratch(src.sparkSession, "jaccard")
    rows = scratch.table(points(src, width, percent, common_shingles(src, width, scratch)), "points")
    scratch.drop("common")
    real = rows.where("doc_id is not null and n > 0")
    first = real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    member = scratch.table(rows.select("doc_id", "s1", "s2", "n").join(first, ["s1", "s2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "members")
    # rows of a set's first document; those whose id can't be another's copy aren't shuffled
    single, near = split_by(real, member.where("node <> doc_id").select("doc_id"), ["doc_id"])
    columns = ["doc_id", "n", "point", "prefix"]
    own = single.select(*columns).unionByName(near.join(first, ["s1", "s2", "n"]).where("doc_id = node").select(*columns)).withColumnRenamed("doc_id", "node")
    own = scratch.table(own, "own")
    scratch.drop("points")
    shared = scratch.table(shared_keys(own.select(F.explode("prefix").alias("key"), F.col("n").cast("int").alias("n"), "node"), percent), "shared")
    held = scratch.table(cells_of(shared, scratch), "cells")
    scratch.drop("shared")
    scratch.drop("held")
    # only sets that meet others go on
    meets = held.select("node").distinct()
    sets = scratch.table(likely(own.drop("prefix"), meets, ["node"], 1 << 20).join(meets, "node", "left_semi").dropDuplicates(["node", "n", "point"]), "sets")
    scratch.drop("own")

    home = held.groupBy("node").agg(F.max(F.struct("m", -F.col("cell"), "cell")).alias("h")).select("node", "h.cell", "h.m")
    # rows of one id with different texts
    several = member.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    several = several.join(member, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    parts, label = [scratch.table(several, "links-of-ids")], None

    def labelled(df, column, out):
        if label is None:
            return df.withColumn(out, F.col(column))
        return df.join(label.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))

    def joined(pairs, texts, name):
        """Labels with the links among pairs as well."""
        parts.append(scratch.table(linked(pairs, texts, width, percent), f"links-{name}"))
        return components(reduce(DataFrame.unionByName, parts), scratch, f"parts-{name}")

    leads = scratch.table(candidates(home.join(sets, "node").withColumn("comp", F.col("node")), percent, True), "leads")
    texts = scratch.table(texts_of(src, leads), "texts")
    label = joined(leads, texts, "home")
    scratch.drop("texts")
    scratch.drop("leads")
    seen = labelled(held, "node", "comp")
    left_open = seen.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("cell")
    members = seen.join(left_open, "cell", "left_semi").join(sets, "node").select("cell", "m", "node", "n", "comp", "point")
    pairs = scratch.table(candidates(members, percent, False), "pairs")
    scratch.drop("cells")
    scratch.drop("sets")
    if not pairs.isEmpty():
        texts = scratch.table(texts_of(src, pairs), "more")
        step, most = 0, 8
        while True:
            left = labelled(labelled(pairs, "a", "comp_a"), "b", "comp_b").where("comp_a <> comp_b")
            place = F.row_number().over(Window.partitionBy(F.least("comp_a", "comp_b"), F.greatest("comp_a", "comp_b")).orderBy(F.desc("over"), "a", "b"))
            left = scratch.table(left.withColumn("place", place).select("a", "b", "over", "place"), f"left-{step}")
            scratch.drop(f"left-{step - 1}" if step else "pairs")
            if left.isEmpty():
                break
            label = joined(left.where(F.col("place") <= most).select("a", "b"), texts, step)
            pairs = left.where(F.col("place") > most).select("a", "b", "over")
            step, most = step + 1, most * 8
        scratch.drop("more")
    return labelled(member, "node", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of smallest id, of each class of jaccard_classes; all columns as they are.

    Texts without words are in no class and stay, as do rows without id. Of rows that share an id the first by text
    stays. Only ids are compared across the table: rows whose id can't be among those to drop aren't shuffled.
    """
    scratch = Scratch(docs.sparkSession, "classes")
    own, (number, place) = docs.columns, spare(docs, "_id", "_place")
    found = scratch.table(jaccard_classes(docs, width, percent, id_col, text_col).where("doc_id is not null"), "found")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(number))
    several = found.groupBy(F.col("doc_id").alias(number)).agg(F.count("*").alias("n")).where("n > 1").select(number)
    placed = docs.withColumn(number, F.col(id_col).cast("long"))
    calm, near = split_by(placed, scratch.table(gone.union(several).distinct(), "doubtful"), [number])
    left = near.join(gone.distinct(), number, "left_anti")
    first = F.when(F.col(number).isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(number).orderBy(F.col(text_col).asc_nulls_last())))
    return calm.select(*own).unionByName(left.withColumn(place, first).where(F.col(place) == 1).select(*own))
