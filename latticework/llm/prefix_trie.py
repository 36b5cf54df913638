"""The trie of all beginnings of conversations, from sorted matrices of turn ids.

A conversation is cut into blocks of BLOCK turns, each a row with the hash of what comes before it, so a row is bounded
and a long conversation is spread. The rows are range-sharded in the order of (block, hash, turns, conversation), and
each Arrow batch of a shard becomes a matrix: sorted by its columns, the changes against the row above, carried on to
the columns behind, mark where the nodes of each depth start, and reduceat sums over them. Only nodes on the first or
last row of a batch can have rows in another one; these are put together by the hash of their turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import tidied
from latticework.llm.conversations import digest, in_order, turns
from latticework.session import Scratch

#: Turns of a block.
BLOCK = 64
#: A rebuilt conversation takes fewer turns than this from another one.
SHARED = 9

NODES = """shard long, start int, j int, key binary, parent_key binary, up array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, n_ends long,
 bytes long, n_children long, n_leaves long, saved_tokens long, ends string, following binary, before binary, path array<int>, kind int"""
#: Kinds of rows that a shard gives: whole nodes, its part of nodes on its edges, and ways of rows into a further block.
WHOLE, EDGE, WAY = 0, 1, 2


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of another: (conv_id, place, key, n_bytes) a turn, and (conv_id, n_turns) of every one.

    Conversation c is the first h turns of c - c % 5, or all it has, then its own from the h-th on; h is crc32(c) % 9.
    """
    own = turns(conversations).select("conv_id", "turn", "role", F.md5("text").alias("tie"), digest("role", "text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows, pieces = in_order(own, "conv_id", [F.asc_nulls_first("turn"), "role", "tie"], scratch, "turns")
    pieces = scratch.table(pieces, "pieces")
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    each = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    each = each.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    each = scratch.table(each.select("conv_id", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "each")
    at = pieces.join(each.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "pid", (F.col("before") - F.col("first")).alias("shift"), "h", "taken")
    placed = rows.join(at, ["conv_id", "pid"]).withColumn("p", F.col("mid") + F.col("shift"))
    tails = placed.where("p >= h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("place"), "key", "n_bytes")
    heads = placed.where(f"p < {SHARED} and conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("p").alias("place"), "key", "n_bytes")
    heads = heads.join(each.select("conv_id", "base", "taken"), "base").where("place < taken").select("conv_id", "place", "key", "n_bytes")
    return tails.unionByName(heads), each.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """block, before (hash of the earlier turns), seq (keys of the turns, end to end), conv_id, sizes (bytes), more (turns follow), following (hash with this block)."""
    own = rows.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "n_bytes"))).alias("t"))
    own = own.select("conv_id", "block", F.expr("unhex(array_join(transform(t, x -> hex(x.key)), ''))").alias("seq"), F.expr("transform(t, x -> x.n_bytes)").alias("sizes"))
    own = own.join(sizes, "conv_id").withColumn("more", F.col("n_turns") > (F.col("block") + 1) * BLOCK)
    short, long = own.where(f"n_turns <= {BLOCK}"), own.where(f"n_turns > {BLOCK}")
    # the hash of a run of blocks: those of its blocks with their numbers, added by exclusive or
    upto = Window.partitionBy("conv_id").orderBy("block")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "block", "seq")).over(upto.rowsBetween(Window.unboundedPreceding, end)) for end in (-1, 0) for k in (1, 2)]
    before, following = (F.unhex(F.concat(*(F.lpad(F.hex(F.coalesce(m, F.lit(0))), 16, "0") for m in marks[a : a + 2]))) for a in (0, 2))
    none = F.lit(bytes(16))
    empty = sizes.where("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.expr("cast(array() as array<long>)").alias("sizes"), F.lit(b"").alias("seq"), F.lit(False).alias("more"), none.alias("before"), none.alias("following"))
    return long.withColumns({"before": before, "following": following}).drop("n_turns").unionByName(short.withColumns({"before": none, "following": none}).drop("n_turns")).unionByName(empty).select("block", "before", "seq", "conv_id", "sizes", "more", "following")


def shard_nodes(batch: pa.RecordBatch, shard: int) -> pa.RecordBatch:
    """The rows of NODES for a batch of blocks: a matrix of turn ids, sorted, whose changed columns mark the nodes."""
    block, before, seq, conv, sizes, more, following = (batch.column(n) for n in ("block", "before", "seq", "conv_id", "sizes", "more", "following"))
    n, block, conv, more = batch.num_rows, np.asarray(block), np.asarray(conv), np.asarray(more.to_numpy(zero_copy_only=False), bool)
    texts, befores, follows = seq.to_pylist(), before.to_pylist(), following.to_pylist()
    length = np.fromiter((len(t) // 16 for t in texts), np.int64, n)
    wide = int(length.max(initial=0))
    halves = np.frombuffer(b"".join(texts), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (halves[order][1:] != halves[order][:-1]).any(1)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    row, col = np.repeat(np.arange(n), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    turn, size = np.full((n, wide), -1, np.int64), np.zeros((n, wide), np.int64)
    turn[row, col], size[row, col] = ids, np.asarray(sizes.flatten())
    group = np.cumsum([0, *((block[i], befores[i]) != (block[i - 1], befores[i - 1]) for i in range(1, n))])
    order = np.lexsort((conv, *(turn[:, k] for k in range(wide - 1, -1, -1)), group))
    turn, size, length, conv, more = turn[order], size[order], length[order], conv[order], more[order]
    # change[r, j]: row r differs from the one above within its first j turns
    change = np.ones((n, wide + 1), bool)
    change[1:, 0] = group[1:] != group[:-1]
    change[1:, 1:] = turn[1:] != turn[:-1]
    np.logical_or.accumulate(change, axis=1, out=change)
    first_group, last_group = group == group[0], group == group[-1]
    same_first = np.logical_and.accumulate(turn == turn[0], axis=1) & first_group[:, None]
    same_last = np.logical_and.accumulate(turn == turn[-1], axis=1) & last_group[:, None]
    depths, starts_of, out = range(wide + 1), [], []
    for j in depths:
        has = length >= j  # rows end, and rows that have fewer turns come first in a group
        starts_of.append(np.flatnonzero(change[:, j] & has))
    below_leaves, below_saved = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a node's children, at their starts
    below_children, above = np.zeros(n, np.int64), {}
    for j in reversed(depths):
        at = starts_of[j]
        if not len(at):
            continue
        # a node's rows go on to the next start at its depth or to the next row that differs within j turns
        stops = np.flatnonzero(change[:, j])
        end = np.append(stops, n)[np.searchsorted(stops, at, "right")]
        bounds = np.stack([at, end], 1).ravel()
        total = lambda x, bounds=bounds: np.add.reduceat(np.append(x, 0), bounds)[::2]
        convs, low = end - at, np.minimum.reduceat(np.append(conv, np.iinfo(np.int64).max), bounds)[::2]
        ends = (length == j) & ~more
        n_ends = total(ends.astype(np.int64))
        edge = np.zeros(len(at), bool)
        edge |= first_group[at] if j == 0 else same_first[at, j - 1] & (length[0] >= j)
        edge |= last_group[at] if j == 0 else same_last[at, j - 1] & (length[-1] >= j)
        last = size[at, j - 1] if j else np.zeros(len(at), np.int64)
        children, leaves, saved = total(below_children), total(below_leaves), total(below_saved)
        leaf = (n_ends == convs) & ~edge
        leaves, saved = leaves + leaf, saved + np.where(edge, 0, (convs - 1) * last)
        below_children, below_leaves, below_saved = (np.zeros(n, np.int64) for _ in range(3))
        below_children[at] = ~edge
        below_leaves[at], below_saved[at] = leaves, saved
        is_node = np.ones(len(at), bool) if j else block[at] == 0  # the top of a later block is the end of the one before
        above[j] = (at, low, edge, convs, n_ends, last, children, leaves, saved, end, is_node)
    records = {c: [] for c in ("start", "j", "key", "parent_key", "up", "conv_id", "parent_conv_id", "n_convs", "n_ends", "bytes", "n_children", "n_leaves", "saved_tokens", "ends", "following", "before", "kind", "depth")}
    empty = hashlib.sha256(b"").hexdigest()
    name = lambda r, j: hashlib.md5(str(int(block[r])).encode() + b":" + befores[order[r]] + texts[order[r]][: 16 * j]).digest()
    for j, (at, low, edge, convs, n_ends, last, children, leaves, saved, end, is_node) in above.items():
        if j:
            up_at, up_low, up_edge = above[j - 1][:3]
            up = np.searchsorted(up_at, at, "right") - 1
        for i in np.flatnonzero(is_node):
            r, e = int(at[i]), bool(edge[i])
            records["start"].append(r)
            records["j"].append(j)
            records["key"].append(name(r, j) if e else None)
            records["parent_key"].append(name(r, j - 1) if j and up_edge[up[i]] and (j > 1 or block[r] == 0) else None)
            records["up"].append([name(r, k) for k in range(int(block[r] > 0), j + 1)] if e else None)
            records["conv_id"].append(int(low[i]))
            records["parent_conv_id"].append(int(up_low[up[i]]) if j else None)
            records["n_ends"].append(int(n_ends[i]))
            own = conv[r : end[i]][((length[r : end[i]] == j) & ~more[r : end[i]])] if n_ends[i] else ()
            said = ",".join(map(str, np.sort(own))) if len(own) else ""
            records["ends"].append(said if e else hashlib.sha256(said.encode()).hexdigest() if said else empty)
            records["following"].append(follows[order[r]] if j == BLOCK and more[r : end[i]].any() else None)
            records["before"].append(befores[order[r]] if j == 1 and block[r] else None)
            records["kind"].append(EDGE if e else WHOLE)
            records["depth"].append(int(block[r]) * BLOCK + j)
        for c, x in (("n_convs", convs), ("bytes", last), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
            records[c].extend(x[is_node].tolist())
    if more.any():  # the node of each depth that rows with further blocks pass
        went = np.stack([above[j][0][np.searchsorted(above[j][0], np.arange(n), "right") - 1] for j in depths], 1)
    ways = np.flatnonzero(more)
    count = len(records["start"])
    fields = dict(f.strip().split(" ") for f in NODES.replace("\n", " ").split(","))
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
    extra = {"conv_id": conv[ways].tolist(), "depth": (block[ways] * BLOCK).tolist(), "path": [went[r].tolist() for r in ways], "kind": [WAY] * len(ways)}
    columns = {}
    for c, kind in fields.items():
        here = [shard] * count if c == "shard" else [None] * count if c == "path" else records[c]
        there = [shard] * len(ways) if c == "shard" else extra.get(c, [None] * len(ways))
        columns[c] = pa.array(here + there, kinds[kind])
    return pa.RecordBatch.from_pydict(columns)


def _sharded(batches):
    task = TaskContext.get().partitionId()
    for k, batch in enumerate(b for b in batches if b.num_rows):
        yield shard_nodes(batch, (task << 33) + k)


def _hashed(batches):
    """key and ends_sha256 of each key's strings (key, first, ends), which come in order, a comma between them."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, said in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(said.encode())
            else:
                state.update(b"," + said.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """RESULT for each distinct beginning of the conversations that rows (conv_id, place, key, n_bytes) and sizes (conv_id, n_turns) give."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["block", "before", "seq", "conv_id"]
    sorted_rows = scratch.table(blocks(rows, sizes), "blocks").repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = scratch.table(sorted_rows.mapInArrow(tidied(_sharded), NODES), "parts")
    nodes, ways = parts.where(f"kind <> {WAY}").drop("path"), parts.where(f"kind = {WAY}").select("shard", "conv_id", "depth", "path")
    mine = F.col("shard"), F.col("start"), F.col("j")

    # nodes on edges, whole: counts and sums over the shards, the rest from the others on edges
    edges = nodes.where(f"kind = {EDGE}")
    whole = edges.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.max("bytes").alias("bytes"), F.max("parent_key").alias("parent_key"), F.max("up").alias("up"), F.max("depth").alias("depth"))
    whole = scratch.table(whole, "whole")
    # each hands what it saves, and a leaf itself, to itself and all that stand above it in its block
    gain = whole.select(F.explode("up").alias("key"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    handed = gain.groupBy("key").agg(F.sum("saved").alias("edge_saved"), F.sum("leaf").alias("edge_leaves"))
    edge_children = whole.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("edge_children"))
    inner = edges.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    put = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    whole = whole.join(inner, "key").join(handed, "key", "left").join(edge_children, "key", "left")
    whole = scratch.table(whole.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_ends", "bytes", put("n_children", "edge_children"), put("n_leaves", "edge_leaves"), put("saved_tokens", "edge_saved")), "summed")
    # the shards learn what their edges are as a whole, so that a key is met a time a shard at most
    known = edges.select("shard", "key").join(whole.select("key", F.col("conv_id").alias("whole_conv_id")), "key")
    parent = known.select("shard", F.col("key").alias("parent_key"), F.col("whole_conv_id").alias("above_conv_id"))
    single = nodes.where(f"kind = {WHOLE}").join(parent, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("above_conv_id", "parent_conv_id"))
    tops = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    digests = edges.where("ends <> ''").select("key", "shard", "ends").repartition(n, "key").sortWithinPartitions("key", "shard").mapInArrow(_hashed, "key binary, ends_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = whole.join(tops, "parent_key", "left").join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    result = single.withColumnRenamed("ends", "ends_sha256").select(*RESULT).unionByName(joined.select(*RESULT))
    if not ways.limit(1).count():
        return result

    # conversations of several blocks: what conversation c alone stands for (it is the least of the node) in later
    # blocks belongs to all nodes that it passes in this one
    from_block = F.floor((F.col("depth") - 1) / BLOCK) * BLOCK
    owned = [df.where(f"depth > {BLOCK}").select("conv_id", from_block.alias("depth"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf")) for df in (single, whole)]
    own = owned[0].unionByName(owned[1]).groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    both = ways.join(own, ["conv_id", "depth"], "full").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(later) for c in ("saved", "leaf")})
    extra = both.where("path is not null and (saved > 0 or leaf > 0)").select("shard", F.posexplode("path").alias("j", "start"), "saved", "leaf")
    extra = scratch.table(extra.groupBy(*mine).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves")), "extra")
    edge_extra = edges.select(*mine, "key").join(extra, ["shard", "start", "j"]).groupBy("key").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    # nodes at the end of a block have their children in the next one
    columns = ["conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "following", "before"]
    put_more = [put("n_leaves", "more_leaves"), put("saved_tokens", "more_saved")]
    first = single.withColumnRenamed("ends", "ends_sha256").join(extra, ["shard", "start", "j"], "left")
    signs = edges.groupBy("key").agg(F.max("following").alias("following"), F.max("before").alias("before"))
    second = joined.join(signs, "key").join(edge_extra, "key", "left")
    rest = [c for c in columns if c not in ("n_leaves", "saved_tokens")]
    every = scratch.table(first.select(*rest, *put_more).unionByName(second.select(*rest, *put_more)), "every")
    heads = every.where("before is not null").groupBy(F.col("before").alias("following"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("next_children"))
    ends = every.where("following is not null").select(F.col("following").alias("before"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("end_conv_id"))
    out = every.join(heads, ["following", "depth"], "left").join(ends, ["before", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("next_children", F.lit(0)))
    return out.withColumn("parent_conv_id", F.coalesce("end_conv_id", "parent_conv_id")).select(*RESULT)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """RESULT: a row for each node of the trie of the rebuilt conversations (see rebuilt), the root included.

    Turns stand in the order of turn, nulls first; of equal turns by role, then by the MD5 of the text. Null roles and
    texts are empty, repeated rows are turns of their own, and rows without conv_id take no part. Turns are told apart
    by 128 bits of MD5, beginnings of over BLOCK turns by 128 bits of xxHash64. An empty table gives an empty table;
    other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    return trie(*rebuilt(conversations, scratch), scratch)
