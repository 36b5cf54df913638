"""The grid order join against all pairs, and searches among cells of few rows."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm.ann import nearest
from latticework.llm.grid_join import Chunks, near_duplicates, tile_links, tile_pairs, units
from latticework.session import Scratch

VECTORS = "vec_id long, embedding array<float>, h1 long, node long, tile long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], VECTORS)


def brute_links(rows, least):
    fit = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n in {len(rows[i][1]) for i in fit}:
        own = [i for i in fit if len(rows[i][1]) == n]
        u = np.array([rows[i][1] for i in own], float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        for x, y in zip(*np.nonzero(u @ u.T >= least), strict=True):
            if x != y:
                links[own[x]] += 1
                a, b = sorted((find(own[x]), find(own[y])))
                root[b] = a
    low = {}
    for i in fit:
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    blank = lambda x: -9 if x is None else x
    found = [(rows[i][0], links[i], low[find(i)] if i in set(fit) else rows[i][0]) for i in range(len(rows))]
    return sorted((blank(k), n, blank(c), k == c) for k, n, c in found)


@pytest.mark.parametrize(("least", "tile_bytes"), [(0.9, 256 * 48), (0.97, 4 << 20)])
def test_grid_join(spark, least, tile_bytes):
    """Clusters, a third of near copies, equal vectors, odd ones, repeated ids and other lengths."""
    g = np.random.default_rng(3)
    c = g.normal(size=(9, 6))
    x = np.concatenate([c[g.integers(9, size=500)] + g.normal(size=(500, 6)) * 0.25, np.repeat(c[:1], 400, 0) + g.normal(size=(400, 6)) * 1e-3, np.repeat(c[1:2], 150, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5000, None), (5001, [0.0] * 6), (5002, [None] + [1.0] * 5), (5003, [float("nan")] + [1.0] * 5), (5008, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (5004, []), (5005, [1.0, 2.0]), (5006, [2.0, 4.0]), (5007, [1e-30, 2e-30]), (5, [3.0, 1.0]), (5, rows[9][1])]
    got = near_duplicates(frame(spark, rows), least=least, tile_bytes=tile_bytes)
    blank = lambda x: -9 if x is None else x
    assert sorted((blank(r[0]), r[1], blank(r[2]), r[3]) for r in got.collect()) == brute_links(rows, least)


def test_grid_join_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_duplicates(frame(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_chunks_miss_nothing():
    """Boxes, balls and products of two tiles, on any orthonormal directions."""
    g = np.random.default_rng(4)
    c = g.normal(size=(40, 10))
    v = [c[g.integers(40, size=n)] + 0.2 * g.normal(size=(n, 10)) for n in (700, 600)]
    v[1][:300] = v[0][5] + 1e-4 * g.normal(size=(300, 10))
    basis, w = np.linalg.qr(g.normal(size=(10, 4)))[0], [g.integers(1, 5, size=n) for n in (700, 600)]
    order = [np.lexsort((units(x) @ basis).T) for x in v]
    v, w = [x[o] for x, o in zip(v, order, strict=True)], [x[o] for x, o in zip(w, order, strict=True)]
    for same in (False, True):
        a = Chunks(v[0], basis)
        b = a if same else Chunks(v[1], basis)
        one, two, root = tile_links(a, b, w[0], w[0] if same else w[1], 0.9, same)
        near = a.u @ b.u.T >= 0.9
        if same:
            np.fill_diagonal(near, False)
        assert (one == near @ (w[0] if same else w[1])).all() and (same or (two == near.T @ w[0]).all())
        x, y = np.nonzero(near)
        assert (root[x] == root[y + (0 if same else 700)]).all()


def test_intervals_keep_all_near_tiles(spark):
    g = np.random.default_rng(6)
    low = g.random((100, 3)) * 2
    high = low + g.random((100, 3)) * 0.2
    tiles = spark.createDataFrame([(t, a.tolist(), b.tolist(), ((a + b) / 2).tolist(), 0.05) for t, (a, b) in enumerate(zip(low, high, strict=True))], "tile long, low array<double>, high array<double>, centre array<double>, radius double")
    got = {(r.a, r.b) for r in tile_pairs(tiles, 100, 0.3, Scratch(spark, "intervals")).collect()}
    gap = np.maximum(0, np.maximum(low[None] - high[:, None], low[:, None] - high[None]))
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero((gap**2).sum(2) <= 0.09), strict=True) if a <= b}
    assert 100 < len(got) < 3000


def test_answers_from_cells_of_few_rows(spark):
    """Ten vectors far from the others, whose cells hold fewer than are asked for; mixed norms; a repeated id."""
    g = np.random.default_rng(5)
    x = g.normal(size=(5000, 8)) * 0.05 + np.eye(8)[0]
    x *= np.exp(g.normal(size=5000))[:, None]
    x[:200:20] = -100 * np.eye(8)[0] + g.normal(size=(10, 8)) * 0.1
    table = pa.table({"vec_id": np.arange(5000), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), "cell": np.zeros(5000), "v": ["x"] * 5000})
    df = spark.createDataFrame(table)
    df = df.unionByName(df.where("vec_id = 7").withColumn("vec_id", F.lit(20).cast("long")))
    got, x = collections.defaultdict(list), x.astype(np.float32).astype(float)
    for r in nearest(df, k=20, every=20, cell=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 5000, 20))
    for q, found in got.items():
        assert sorted(f[0] for f in found) == list(range(1, 21))
        assert q == 20 or (all(f[1] == 20 or np.isclose(x[f[1]] @ x[q], f[2]) for f in found))


def test_nearest_of_queries_unlike_the_rows(spark):
    """Queries in all directions among rows about one, mixed norms: the sample's nearest tell nothing of theirs."""
    g = np.random.default_rng(8)
    n = 4000
    x = (g.normal(size=(n, 16)) * 0.05 + 3 * np.eye(16)[0]) * np.exp(g.normal(size=n) * 0.5)[:, None]
    x[::20] = g.normal(size=(n // 20, 16))
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = collections.defaultdict(list)
    for r in nearest(df, cell=200).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    x = x.astype(float)
    for q in range(0, n, 20):
        score = np.einsum("nd,d->n", x, x[q])
        score[q] = -np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(n), -score))[:20].tolist()
