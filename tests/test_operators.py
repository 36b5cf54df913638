"""Invariants, numpy comparisons and error paths."""

import json
import tempfile
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from latticework import queries as Q
from latticework.functions import kernels as K
from latticework.functions import names as N
from latticework.functions import results as R
from latticework.operators import boxes as B
from latticework.operators import estimate as E
from latticework.operators import matrix as M
from latticework.operators import mesh as G
from latticework.operators import report as T
from latticework.operators import solve as S
from latticework.operators.quantiles import quantiles
from latticework.operators.right_hand_sides import right_hand_side
from latticework.session import Scratch
from latticework.sources import points as P
from latticework.sources import results as D
from latticework.sources import samples as A
from latticework.sources.stats_files import StatsFiles


def matrix(spark, a):
    a = np.asarray(a, complex)
    return spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(a)], "i long, j long, re double, im double")


def vector(spark, v, vec=0):
    return spark.createDataFrame([(vec, i, float(x.real), float(x.imag)) for i, x in enumerate(np.asarray(v, complex))], "vec int, idx long, re double, im double")


def as_array(df, n):
    out = np.zeros(n, complex)
    for r in df.collect():
        out[r.idx] = r.re + 1j * r.im
    return out


@pytest.fixture(scope="module")
def small():
    g = np.random.default_rng(4)
    return g.normal(size=(12, 12)) + 1j * g.normal(size=(12, 12)) + 8 * np.eye(12), g.normal(size=12) + 1j * g.normal(size=12)


def test_modes(spark, small):
    a, x = small
    want = {"none": a @ x, "transpose": a.T @ x, "conj": a.conj() @ x, "adjoint": a.conj().T @ x}
    op = M.Operator(matrix(spark, a))
    for mode, y in want.items():
        assert np.allclose(as_array(M.apply_matrix(matrix(spark, a), vector(spark, x), mode), 12), y)
        assert np.allclose(as_array(op.apply(vector(spark, x), mode), 12), y)
    assert np.allclose(as_array(M.apply_normal(matrix(spark, a), vector(spark, x)), 12), a.conj().T @ a @ x)
    with pytest.raises(ValueError):
        M.apply_matrix(matrix(spark, a), vector(spark, x), "inverse")


@pytest.mark.parametrize("mode", sorted(M.RANK_ONE))
def test_rank_one(spark, small, mode):
    a, x = small
    f = M.rank_one_factors(vector(spark, x), vector(spark, a[0]), mode, 0.01).cache()
    dense = np.zeros((12, 12), complex)
    for r in M.rank_one_matrix(f).collect():
        dense[r.i, r.j] = r.re + 1j * r.im
    for how, y in (("none", dense @ x), ("transpose", dense.T @ x), ("adjoint", dense.conj().T @ x)):
        assert np.allclose(as_array(M.apply_rank_one(f, vector(spark, x), how), 12), y)
    if mode.endswith("_symmetric"):
        assert np.allclose(dense, dense.T)
    if mode == "hermitian":
        assert np.allclose(dense, dense.conj().T)


def test_adjoint_defect_is_small_and_estimates_hold(spark, small):
    a, x = small
    m, s = matrix(spark, a), P.gaussian_vectors(spark.range(12), 30, complex_values=True).withColumnRenamed("sample", "vec")
    assert E.adjoint_defect(m, s, s).first().defect <= 1e-12
    assert E.max_error(M.apply_matrix(m, s), M.apply_matrix(m, s)).first().max_err == 0
    assert E.two_norm_estimate(m, s).first().norm_2 <= np.linalg.norm(a, 2) * (1 + 1e-12)
    lam = E.power_iteration(m, vector(spark, x), 12).orderBy(F.desc("step")).first().lam
    assert abs(lam**0.5 - np.linalg.norm(a, 2)) < 0.05 * np.linalg.norm(a, 2)
    assert E.power_iteration(m, vector(spark, np.zeros(12)), 3).first().lam == 0


def vectors(spark, columns):
    return spark.createDataFrame([(k, i, float(x.real), float(x.imag)) for k, v in enumerate(columns) for i, x in enumerate(np.asarray(v, complex))], "vec int, idx long, re double, im double")


def as_arrays(df, n, count):
    return [as_array(df.where(F.col("vec") == k), n) for k in range(count)]


def test_gmres_and_blocks(spark, small):
    a, x = small
    m, b, steps = matrix(spark, a), vector(spark, a @ x), []
    got, history = S.gmres(lambda v: M.apply_matrix(m, v), b, tolerance=1e-9, restart=6, most=10, callback=lambda v, k, r: steps.append(r))
    history = history[0]
    assert steps == history and history[-1] < history[0] and len(history) <= 10
    residual = np.linalg.norm(a @ x - a @ as_array(got, 12)) / np.linalg.norm(a @ x)
    assert abs(residual - history[-1]) < 1e-6
    boxes = spark.createDataFrame([(i // 4, i) for i in range(12)], "key int, idx long")
    y = as_array(S.block_solve(m, boxes, b), 12)
    for k in range(3):
        own = slice(4 * k, 4 * k + 4)
        assert np.allclose(a[own, own] @ y[own], (a @ x)[own])
    with pytest.raises(PySparkException):
        S.block_solve(matrix(spark, np.zeros((12, 12))), boxes, b).collect()
    for fail in (S.block_factors, lambda *args, **kw: S.block_solve(*args, b, **kw)):
        with pytest.raises(ValueError):
            fail(m, boxes, most=3)


def test_gmres_of_several_right_hand_sides(spark):
    a = np.diag([2.0, 4.0])
    got, history = S.gmres(lambda v: M.apply_matrix(matrix(spark, a), v), vectors(spark, [[2, 4], [6, 8], [0, 0], [0, 4]]))
    for y, want in zip(as_arrays(got, 2, 4), ([1, 1], [3, 2], [0, 0], [0, 1]), strict=True):
        assert np.allclose(y, want)
    assert [len(history[v]) for v in range(4)] == [2, 2, 0, 1]
    with pytest.raises(ValueError):
        S.gmres(lambda v: v, vectors(spark, [[1, 2], [3, 4]]), most_vectors=1)
    with pytest.raises(ValueError):
        S.gmres(lambda v: v, vectors(spark, [[1, 2]]).withColumn("vec", F.lit(None).cast("int")))
    none, empty = S.gmres(lambda v: v, vectors(spark, []))
    assert none.count() == 0 and empty == {}


def test_preconditioned_histories(spark):
    g = np.random.default_rng(6)
    a = np.diag(np.repeat([2.0, 6.0, 18.0], 8) * g.uniform(1, 2, 24)) + 0.05 * (g.normal(size=(24, 24)) + 1j * g.normal(size=(24, 24)))
    for k in range(3):
        a[8 * k : 8 * k + 8, 8 * k : 8 * k + 8] += 0.3 * g.normal(size=(8, 8))
    xs = [g.normal(size=24) + 1j * g.normal(size=24) for _ in range(3)]
    m, b = M.StoredMatrix(matrix(spark, a)), vectors(spark, [a @ x for x in xs])
    boxes = spark.createDataFrame([(i // 8, i) for i in range(24)], "key int, idx long")
    factors = S.block_factors(matrix(spark, a), boxes).cache()
    apply = lambda v: M.apply_matrix(m, v)
    plain, no_prec = S.gmres(apply, b, tolerance=1e-4, restart=6)
    quick, prec = S.gmres(apply, b, lambda v: S.apply_inverse(factors, v), tolerance=1e-4, restart=6)
    for k, x in enumerate(xs):
        assert len(prec[k]) < len(no_prec[k]) and max(prec[k][-1], no_prec[k][-1]) <= 1e-4
        assert np.allclose(as_arrays(quick, 24, 3)[k], x, atol=1e-2)
        assert np.allclose(as_arrays(plain, 24, 3)[k], x, atol=1e-2)
    m.drop()
    other = a + 0.01 * g.normal(size=a.shape)
    got = {r.key: r for r in S.block_errors(matrix(spark, other), boxes, factors).collect()}
    for k in range(3):
        e, f = other[8 * k : 8 * k + 8, 8 * k : 8 * k + 8], a[8 * k : 8 * k + 8, 8 * k : 8 * k + 8]
        assert got[k].n == 8 and np.isclose(got[k].err_block, np.linalg.norm(e - f, 2) / np.linalg.norm(e, 2))
        assert np.isclose(got[k].err_inverse, np.linalg.norm(np.linalg.inv(f) @ e - np.eye(8), 2))


def plan_of(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def above_scans(plan):
    """For each scan of a stored matrix, the nodes from the scan to the first join above it, by indentation."""
    lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.split("\n")]
    for at, (deep, text) in enumerate(lines):
        if "FileScan" in text and "matrix_" in text:
            for up, line in reversed(lines[:at]):
                if up < deep:
                    deep = up
                    yield line
                    if "Join" in line:
                        break


def test_products_do_not_shuffle_the_stored_matrix(spark, small):
    a, x = small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = M.StoredMatrix(matrix(spark, a), heavy_rows=5)
        assert m.heavy["i"].count() == 12 and m.entries("i").select("part").distinct().count() > 1  # every index is split
        for mode, want in {"none": a @ x, "transpose": a.T @ x, "conj": a.conj() @ x, "adjoint": a.conj().T @ x}.items():
            y = M.apply_matrix(m, vector(spark, x), mode)
            path = list(above_scans(plan_of(y)))
            assert any("Join" in p for p in path) and not any("Exchange" in p for p in path)
            assert np.allclose(as_array(y, 12), want)
        lam = E.power_iteration(m, vector(spark, x), 3).orderBy("step").collect()
        v = x / np.linalg.norm(x)
        for r in lam:
            z = a.conj().T @ (a @ v)
            assert np.isclose(r.lam, abs(v.conj() @ z))
            v = z / np.linalg.norm(z)
        assert np.isclose(E.power_iteration(m, vector(spark, x), 1, normal=False).first().lam, abs(x.conj() @ a @ x) / np.linalg.norm(x) ** 2)
        m.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        E.power_iteration(matrix(spark, a), vectors(spark, [x, x]), 2)


def test_product_with_a_heavy_inner_index(spark):
    g = np.random.default_rng(8)
    a, b = (g.random((40, 30)) < 0.1) * g.normal(size=(40, 30)), (g.random((30, 50)) < 0.1) * g.normal(size=(30, 50))
    a[:, 7], b[7] = g.normal(size=40), g.normal(size=50)  # one inner index has a third of the entries
    kept = lambda m: matrix(spark, m).where("re <> 0")
    for rows in (10, 1 << 16):
        out = M.matrix_product(kept(a), kept(b), heavy_rows=rows)
        got = np.zeros((40, 50), complex)
        for r in out.collect():
            got[r.i, r.j] = r.re + 1j * r.im
        assert np.allclose(got, a @ b)
    tiles = M.heavy_parts(kept(a).groupBy("j").count().withColumnRenamed("count", "n"), "j", 10)
    assert tiles.where("j = 7").first().parts >= 4


def test_offsets_by_tiles(spark):
    n = 6
    grid = P.regular_grid(spark, n, 2)
    g = np.random.default_rng(2)
    table, x = g.normal(size=(n + 1, n + 1)), g.normal(size=(n + 1) ** 2)
    values = spark.createDataFrame([(p, q, 0, float(table[p, q]), 0.5) for p in range(n + 1) for q in range(n + 1)], "d0 int, d1 int, d2 int, re double, im double")
    want = np.array([[table[abs(i // 7 - j // 7), abs(i % 7 - j % 7)] + 0.5j for j in range(49)] for i in range(49)])
    for most in (1 << 18, 10):
        y = M.apply_offsets(n, 2, grid, values, vector(spark, x), most)
        assert np.allclose(as_array(y, 49), want @ x)
        assert "Cartesian" not in plan_of(y) and "NestedLoop" not in plan_of(y)
    m = M.offset_matrix(n, 2, grid, values)
    assert all(np.isclose(r.re + 1j * r.im, want[r.i, r.j]) for r in m.collect()) and m.count() == 49**2
    for bad in (values.limit(5), values.unionByName(values.limit(1)).limit(49).withColumn("d0", F.lit(0))):
        with pytest.raises(ValueError):
            M.apply_offsets(n, 2, grid, bad, vector(spark, x))


def test_perturbation_of_terms(spark, small):
    a, x = small
    u, v, alpha = a[:3] * (np.arange(12) % 3 == np.arange(3)[:, None]), a[3:6], [1 + 2j, -0.5, 0.3j]
    as_terms = lambda m: spark.createDataFrame([(t, i, float(z.real), float(z.imag)) for t, row in enumerate(m) for i, z in enumerate(row) if z], "term int, idx long, re double, im double")
    terms = M.perturbation_terms(as_terms(u), as_terms(v), spark.createDataFrame([(t, complex(c).real, complex(c).imag) for t, c in enumerate(alpha)], "term int, re double, im double"))
    for kept in (None, [0, 2], []):
        dense = sum((alpha[t] * np.outer(u[t], v[t].conj()) for t in range(3) if kept is None or t in kept), np.zeros((12, 12), complex))
        got = np.zeros((12, 12), complex)
        for r in M.terms_matrix(terms, kept).collect():
            got[r.i, r.j] = r.re + 1j * r.im
        assert np.allclose(got, dense)
        for mode, want in {"none": dense @ x, "transpose": dense.T @ x, "conj": dense.conj() @ x, "adjoint": dense.conj().T @ x}.items():
            assert np.allclose(as_array(M.apply_terms(terms, vector(spark, x), mode, kept), 12), want)


def plain_quantiles(v, shares):
    return [float(np.quantile(v, p)) for p in shares]


def test_quantiles_in_ranges(spark):
    g = np.random.default_rng(5)
    groups = {"even": g.normal(size=4000), "ties": np.repeat([3.0, 1.0, 2.0], [5000, 40, 60]), "few": np.array([5.0]), None: g.integers(0, 4, 900).astype(float), "wide": np.exp(g.normal(size=3000) * 9), "signs": np.array([-0.0, 0.0] * 700 + [1.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    df, shares = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    for most in (60, 1 << 20):
        got = {r.k: r.q for r in quantiles(df, ["k"], "v", shares, most).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert np.allclose(got[k], plain_quantiles(v, shares), rtol=1e-12, atol=0), (k, most)
    every = np.concatenate(list(groups.values()))
    assert np.allclose(quantiles(df, [], "v", shares, 500).first().q, plain_quantiles(every, shares), rtol=1e-12)
    assert quantiles(df.limit(0), [], "v", shares).count() == 0 and quantiles(df.limit(0), ["k"], "v", shares).count() == 0
    box = {r.k: r for r in T.box_plot(df, ["k"], "v", most=100).collect()}
    assert box["ties"].q1 == box["ties"].q3 == 3.0 and box["ties"].n_outliers == 100 and box[None].median == np.median(groups[None])
    assert {r.k: r.median for r in T.level_summary(df, ["k"], "v", most=64).collect()}.keys() == groups.keys()
    assert T.contrast(df.where("v is null"), "v").where("scaled is not null").count() == 0


def test_leaves_by_range(spark):
    g = np.random.default_rng(7)
    x = np.concatenate([g.random((300, 3)), g.random((200, 3)) * 0.01, np.repeat([[0.3, 0.3, 0.3]], 150, 0)])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    for depth, most in ((5, 20), (0, 5), (20, 30)):
        fine = B.finest_boxes(points, depth).cache()
        counts = B.box_counts(fine, depth)
        got = {r.id: (r.level, r.key) for r in B.leaves(fine, B.leaf_boxes(counts, most, depth), depth).collect()}
        low, side = x.min(0), (x.max(0) - x.min(0)).max()
        want = {}
        for level in range(depth + 1):
            cell = np.minimum(np.floor((x - low) / side * 2**depth).astype(np.int64), 2**depth - 1) >> (depth - level)
            _, inverse, n = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
            for i in range(len(x)):
                if i not in want and (n[inverse.ravel()[i]] <= most or level == depth):
                    want[i] = (level, sum(int(cell[i, a]) >> b & 1 << 0 and 1 << (3 * b + a) for a in range(3) for b in range(level)))
        assert got == want
    assert B.leaves(B.finest_boxes(points.limit(0), 3), B.leaf_boxes(B.box_counts(B.finest_boxes(points.limit(0), 3), 3), 5, 3), 3).count() == 0
    with pytest.raises(ValueError):
        B.finest_boxes(points, 21)


def test_kernel_operator_is_symmetric(spark):
    p = Q.points(spark, SF).where("id < 40")
    op, x = M.make_operator("kernel", p), P.test_vector(p)
    assert np.allclose(as_array(op.apply(x), 40), as_array(op.apply(x, "transpose"), 40))
    blocks = [as_array(M.kernel_apply(p, x, blocks=k), 40) for k in (1, 3)]
    assert np.allclose(*blocks)


def test_unknown_names(spark):
    for fail in (lambda: K.lookup("x"), lambda: M.make_operator("x"), lambda: D.load_stats(spark, "/tmp", "x"), lambda: A.canonical("x"), lambda: T.metric_series(None, 9), lambda: P.square_points(spark, 3, 5), lambda: M.rank_one_factors(None, None, "x", 1.0), lambda: D.typed(None, "x")):
        with pytest.raises(ValueError):
            fail()
    with pytest.raises(ValueError):
        M.checked(spark.range(1))
    x = P.test_vector(spark.range(3))
    assert M.checked(x, spark.range(3)) is x
    for bad in (x.withColumn("re", F.lit("a")), x.where("idx < 2"), x.union(x), P.test_vector(spark.range(4))):
        with pytest.raises(ValueError):
            M.checked(bad, spark.range(3))
    with pytest.raises(PySparkException):
        spark.range(1).select(R.leaf_size(F.lit(3.0), F.lit("trefoil"))).collect()


def test_result_files(spark):
    folder = Path(tempfile.mkdtemp())
    for name in ("error_stats_1e-2", "error_stats_4e1", "error_stats_abc", "block_error_stats_4e1"):
        (folder / f"{name}.json").write_text(json.dumps({"dim": 7, "norm_a_2": None}))
    got = D.typed(D.load_stats(spark, str(folder), "error"), "error").orderBy("tolerance").collect()
    assert [(r.tolerance, r.dim, r.norm_a_2) for r in got] == [(0.01, 7, None), (40.0, 7, None)]
    start = spark.sql("select current_timestamp() - interval 1 hour as t").first().t
    assert D.fresh(spark, str(folder), start).count() == 4
    with pytest.raises(PySparkException):
        D.fresh(spark, str(folder), spark.sql("select current_timestamp() + interval 1 hour as t").first().t).collect()


def test_documents_that_lack_fields(spark):
    docs = lambda *texts: spark.createDataFrame([(0.1, t) for t in texts], "tolerance double, doc string")
    rank = {"residual_size": 1, "ranks": [], "compression": [], "box_sizes": [], "near_field_sizes": [], "dec_boxes_per_level": [2]}
    assert D.typed(docs(json.dumps(rank)), "rank").first().dec_boxes_per_level == [2]
    for bad in (json.dumps({k: v for k, v in rank.items() if k != "ranks"}), "{"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            D.typed(docs(bad), "rank").collect()
    values = lambda *texts: spark.createDataFrame([(t,) for t in texts], "values string")
    assert D.decode_vector(values("[1, 2]", "[]", None, "[[3, 4]]")).collect() == [(0, 1.0, 0.0), (1, 2.0, 0.0), (0, 3.0, 4.0)]
    for bad in ("{}", '"x"', "x", "[1, null]", "[[1]]"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            D.decode_vector(values(bad)).collect()


def test_written_files(spark):
    folder = tempfile.mkdtemp()
    own = spark.createDataFrame([("error", 0.01, '{"dim": 1}'), ("rank", 40.0, "{}"), ("time", 0.01, "{}")], "kind string, tolerance double, doc string")
    assert D.write_stats(own, folder, "rank") == 2 and D.write_stats(own, folder) == 3
    assert sorted(p.name for p in Path(folder).glob("*.json")) == ["error_stats_1e-2.json", "rank_stats_4e1.json", "time_stats_1e-2.json"]
    with pytest.raises(ValueError):
        D.write_stats(own.union(own), folder)


def test_stats_source(spark):
    """Files replaced in place, many a partition, none touched by a job that fails."""
    folder = tempfile.mkdtemp()
    named = lambda rows: spark.createDataFrame(rows, "kind string, name string, doc string")
    save = lambda df: df.write.format("stats_files").mode("append").save(folder)
    StatsFiles.register(spark)
    save(named([("rank", f"rank_stats_{k}", f"old {k}") for k in range(300)] + [("error", "error_stats_1e-2", "é")]).repartition(5))
    save(named([("rank", f"rank_stats_{k}", f"new {k}") for k in range(100)]))
    (Path(folder) / "rank_stats_x.json").write_text("no number")
    got = {(r.kind, r.tolerance): r.doc for r in spark.read.format("stats_files").load(folder).collect()}
    assert got == {("rank", float(k)): f"{'new' if k < 100 else 'old'} {k}" for k in range(300)} | {("error", 0.01): "é"}
    assert spark.read.format("stats_files").option("kind", "error").load("file:" + folder).count() == 1
    before = sorted(p.name for p in Path(folder).iterdir())
    assert not [n for n in before if n.startswith("_draft")]
    twice = named([("rank", "rank_stats_5", "a"), ("rank", "rank_stats_5", "b")])
    stops = named([("rank", "rank_stats_6", "c"), ("rank", "rank_stats_7", "d")]).repartition(2).withColumn("doc", F.when(F.col("name") == "rank_stats_7", F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.col("doc")))
    for bad in (twice.repartition(2, "doc"), twice.coalesce(1), named([("x", "../x", "y")]), stops):
        with pytest.raises((PySparkException, Py4JJavaError)):
            save(bad)
    assert [n for n in sorted(p.name for p in Path(folder).iterdir()) if not n.startswith("_draft")] == before
    kept = {(r.kind, r.tolerance): r.doc for r in spark.read.format("stats_files").load(folder).collect()}
    assert kept == got


def test_right_hand_sides_refuse(spark):
    p = P.sphere_points(spark.range(5))
    for operator, more in (("Unknown", {}), ("BemppClLaplaceSingleLayer", {"problem": "Neumann"}), ("BemppClLaplaceSingleLayer", {}), ("BemppClMaxwellEfie", {"precision": "half"})):
        with pytest.raises(ValueError):
            right_hand_side(p, operator, p, **more)
    single = right_hand_side(p, "BemppClHelmholtzSingleLayer", p, kappa=1.0, precision="single")
    assert dict(single.dtypes)["re"] == "float" and single.count() == 25


def test_clip_keeps_areas(spark):
    v, e = G.torus(spark, 6, 5)
    area = lambda df: {r.eid: r.area for r in G.area(df).groupBy("eid").agg(F.sum("area").alias("area")).collect()}
    whole, cut = area(G.with_corners(v, e)), area(G.quadrant_clip(v, e, 0.123, 0.045))
    assert whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-9 for k in whole)


def test_sample_store(spark):
    folder, ids = tempfile.mkdtemp() + "/store", spark.range(20)
    apply = lambda x, mode: x
    assert A.ensure_samples(ids, 3, folder, apply) == 3 and A.ensure_samples(ids, 5, folder, apply) == 2 and A.ensure_samples(ids, 4, folder, apply) == 0
    assert A.sample_shape(spark, "z_sketch", "/nowhere", folder) == (5, 20)
    assert A.sample_shape(spark, "y_test", "/nowhere") is None
    y = {(r.sample, r.idx): r.re for r in A.read_samples(spark, "y_test", folder).collect()}
    w = {(r.sample, r.idx): r.re for r in P.gaussian_vectors(ids, 5).collect()}
    assert y == w
    with pytest.raises(ValueError):
        A.append_samples(P.gaussian_vectors(spark.range(9), 1), "y_test", folder)
    with pytest.raises(ValueError):
        A.append_samples(P.gaussian_vectors(ids, 1).drop("im"), "y_test", folder, force_complex=False)


def test_sample_store_after_a_crash(spark):
    """A run that stops between two bases changes nothing; the next one makes all sides whole."""
    folder, ids = tempfile.mkdtemp() + "/store", spark.range(10)
    shapes = lambda: [A.sample_shape(spark, b, folder) for b in A.BASES]

    def broken(x, mode):
        if mode == "transpose":
            raise RuntimeError("stopped")
        return x

    with pytest.raises(RuntimeError):
        A.ensure_samples(ids, 3, folder, broken)
    assert shapes() == [None] * 4
    assert A.ensure_samples(ids, 3, folder, lambda x, mode: x) == 3 and shapes() == [(3, 10)] * 4
    with pytest.raises(RuntimeError):
        A.ensure_samples(ids, 5, folder, broken)
    assert shapes() == [(3, 10)] * 4 and A.read_samples(spark, "y_test", folder).count() == 30
    assert A.ensure_samples(ids, 5, folder, lambda x, mode: x) == 2 and shapes() == [(5, 10)] * 4
    assert A.vacuum(spark, folder) == 4 and A.read_samples(spark, "z_sketch", folder).select("sample").distinct().count() == 5
    # of two writers that start together the second gets an error, and can start again
    one, two = A.Store(spark, folder), A.Store(spark, folder)
    new = A._blocks(P.gaussian_vectors(ids, 1), "y_test", True)
    one.commit({"y_test": one.stage(new, "y_test", True)})
    with pytest.raises(ValueError):
        two.commit({"y_test": two.stage(new, "y_test", True)})
    assert A.sample_shape(spark, "y_test", folder) == (6, 10)
    with pytest.raises(ValueError):
        A.ensure_samples(ids, 9, folder, lambda x, mode: x)  # y_sketch has one less


def test_colours_match_the_sweep(spark):
    boxes = B.box_counts(B.finest_boxes(Q.points(spark, SF), 2), 2).where("level = 2")
    near = B.neighbours(boxes)
    got = {r.key: r.colour for r in B.colours(boxes.select("level", "key"), near).collect()}
    reach = {k: {k} for k in got}
    for r in near.collect():
        reach[r.key].add(r.other)
    want = {}
    for k in sorted(got):
        taken = {want[j] for j in want if reach[j] & reach[k]}
        want[k] = min(set(range(len(taken) + 1)) - taken)
    assert got == want


def test_mesh_reports(spark):
    v, e = G.torus(spark, 6, 5)
    good = G.manifold_report(v, e).first()
    assert good.closed and good.volume > 0
    assert G.manifold_report(*G.torus(spark, 6, 5, hole=True)).first().n_boundary == 3
    assert G.manifold_report(*G.torus(spark, 6, 5, flip=True)).first().n_same_way == 3
    assert G.mesh_components(G.torus(spark, 6, 5, copies=2)[1], 61).count() == 0


def test_gate(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 0.5)], "case string, metric string, value double")
    t = spark.createDataFrame([("a", "x", 1.0, None), ("a", "y", 2.0, None), ("b", "x", 1.0, None), ("b", "z", None, None)], "case string, metric string, max_value double, expected long")
    assert {r["case"]: (r.n_failed, r.failed, r.verdict) for r in T.gate(m, t).collect()} == {"a": (2, "x,y", "FAIL"), "b": (0, "", "PASS")}


def test_offset_matrix_checks_its_grid(spark):
    with pytest.raises(ValueError):
        M.offset_matrix(4, 2, P.regular_grid(spark, 3, 2), spark.range(1))


def test_formatted_numbers_round_as_c(spark):
    """Exact binary values, halves to even; Java's own formatting rounds the shortest decimal, halves up."""
    x = [1445.0, 1455.0, 1.005, 0.125, 0.0, 10050.0, 1e-5, -2.5e-7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*x, None, float("nan")])], "i int, v double")
    got = df.select("i", N.two_digits(F.col("v")).alias("two"), N.formatted(F.col("v"), ".2f").alias("plain")).orderBy("i").collect()
    assert [r.two for r in got] == ["1.44e3", "1.46e3", "1.00e0", "1.25e-1", "0.00e0", "1.00e4", "1.00e-5", "-2.50e-7", "null", "NaN"]
    assert [r.plain for r in got[:4]] == ["1445.00", "1455.00", "1.00", "0.12"]


def test_row_sums_make_no_entries(spark):
    """Overlapping terms, of places with zeros, against the matrix; no join by pairs in the plan."""
    rows = [(t, i, float(i % 3 == t) * (i + 1), 0.5 * t, float(i % 4 != t), 0.1 * i * (i % 4 != t), 1.0 + t, -0.5) for t in range(3) for i in range(12) if (i + t) % 5]
    terms = spark.createDataFrame(rows, "term int, idx long, u_re double, u_im double, v_re double, v_im double, alpha_re double, alpha_im double")
    for kept in (None, [0, 2]):
        m = M.terms_matrix(terms, kept).withColumn("w", F.cos(F.col("j")))
        want = m.groupBy("i").agg(F.sum(F.col("re") * F.col("w")), F.sum(F.col("im") * F.col("w")), F.count("*")).orderBy("i").collect()
        got = M.row_sums(terms, F.cos("idx"), kept).orderBy("idx").collect()
        assert np.allclose([tuple(r) for r in got], [tuple(r) for r in want])
    plan = M.row_sums(terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()


def test_offsets_by_lines(spark):
    """In the plane and in space no group is wider than a line, and two vectors get the matrix's products."""
    for n, ndim in ((4, 2), (2, 3)):
        m, g = n + 1, np.random.default_rng(2)
        size = m**ndim
        at = np.stack(np.unravel_index(np.arange(size), (m,) * ndim), 1)
        k = g.normal(size=(m,) * ndim) + 1j * g.normal(size=(m,) * ndim)
        x = g.normal(size=(2, size)) + 1j * g.normal(size=(2, size))
        grid = spark.range(size)
        values = spark.createDataFrame([(*map(int, [*d, 0][:3]), float(k[tuple(d)].real), float(k[tuple(d)].imag)) for d in at], "d0 int, d1 int, d2 int, re double, im double")
        y = M.apply_offsets(n, ndim, grid, values, vector(spark, x[0]).unionByName(vector(spark, x[1], 1)))
        dense = k[tuple(np.moveaxis(np.abs(at[:, None] - at[None]), 2, 0))]
        for v in range(2):
            assert np.allclose(as_array(y.where(F.col("vec") == v), size), dense @ x[v])
        assert "_block" not in y._jdf.queryExecution().analyzed().toString()


def test_samples_of_one_block_are_dealt_out(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        samples = spark.range(40960).selectExpr("id as sample", "id % 2 as idx", "1D as re", "0D as im")
        A.write_samples(samples, "y_test", str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "s").glob("pieces/*/block=0/part-*"))) > 1
    assert A.read_samples(spark, "y_test", str(tmp_path / "s")).count() == 40960


def test_tile_sums(spark):
    """Every array kernel against its column form over all pairs, in several tiles; no pair is a row of the plan."""
    p = Q.points(spark, SF).limit(150)
    n = p.count()
    for name in K.KERNELS:
        want = M.kernel_matrix(p, name, 2.0).groupBy("i").agg(F.sum("re"), F.sum("im")).orderBy("i").collect()
        got = M.tile_sums(p, p, K.values(name, n, 2.0), ["re", "im"], tile=40).orderBy("id").collect()
        assert np.allclose([tuple(r) for r in got], [tuple(r) for r in want], rtol=1e-12)
    weighted = p.withColumn("w", F.col("id") % 7)
    y = M.tile_sums(p.withColumn("x", F.col("x") + 3), weighted, lambda d, w: [w + 0 * d], ["s"], ["w"], 60)
    total = weighted.agg(F.sum("w")).first()[0]
    assert {r.s for r in y.collect()} == {float(total)} and "Join" not in plan_of(y)


def test_mesh_components_broadcast_nothing(spark):
    """Labels of every step are shuffled; what is broadcast passes the driver."""
    _, elements = G.torus(spark, 6, 5, copies=2)
    found = G.mesh_components(elements, 10)
    assert "Broadcast" not in plan_of(found)
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 60), (60, 60)}


def test_blocks_of_the_coupled_matrix(spark):
    """The diagonal blocks alone have the whole matrix's entries."""
    rows = lambda df: {(r.i, r.j): round(r.re, 9) for r in df.collect()}
    whole, own = rows(Q.coupled(spark, SF)), rows(Q.coupled(spark, SF, 32))
    assert own == {k: v for k, v in whole.items() if k[0] // 32 == k[1] // 32} and len(own) < len(whole) / 2


def test_tiled_matrix(spark, small):
    """Products of a matrix in tiles, split by place and by hash, are the plain ones, rows without products left out."""
    g = np.random.default_rng(9)
    a = (g.random((60, 40)) < 0.2) * (g.normal(size=(60, 40)) + 1j * g.normal(size=(60, 40)))
    a[7] = 3.0
    entries = [(10**12 * (k - 30), 5 * l - 90, float(v.real) / n, float(v.imag) / n) for (k, l), v in np.ndenumerate(a) if v for n in [1 + k % 3] for _ in range(n)]
    more = [(None, 0, 1.0, 2.0), (10**12, None, 3.0, 0.0), (0, 5, None, 1.0)]
    df = spark.createDataFrame(entries + more, "i long, j long, re double, im double").repartition(3)
    rows = lambda df: {(r.vec, r.idx): complex(r.re, r.im) for r in df.collect()}
    filled = df.na.fill(0.0, ["re", "im"])
    for most in (M.TILE_ENTRIES, 50, 3):
        m = M.TiledMatrix(df, most=most)
        assert most > 50 or m.size > 4
        for mode in M.MODES:
            n, at = (60, lambda k: 10**12 * (k - 30)) if mode in ("transpose", "adjoint") else (40, lambda k: 5 * k - 90)
            x = [(vec, at(int(k)), *map(float, g.normal(size=2))) for vec in "pq" for k in g.choice(n, 12 if vec == "p" else n, replace=False)]
            x = spark.createDataFrame(x + [("p", None, 1.0, 1.0), ("q", 3, 1.0, 1.0), ("p", 0, 1.0, 0.0)], "vec string, idx long, re double, im double")
            got, want = rows(M.apply_matrix(m, x, mode)), rows(M.apply_matrix(filled, x, mode))
            assert got.keys() == want.keys() and all(np.isclose(got[k], v) for k, v in want.items())
        m.drop()
    spread = [c[0].shape for c in M._cut_cells(*(np.arange(64),) * 2, np.full(64, 10), (1, 1), 20)]
    assert len(spread) < 64  # tiles grow with the entries of a diagonal, not with its square
    empty = M.TiledMatrix(df.limit(0))
    assert M.apply_matrix(empty, vector(spark, [1, 2])).count() == 0


def test_tiled_products_shuffle_vectors_and_sums_only(spark):
    """The tiles are read where they are multiplied, and a product leaves a row for each row of a tile, not for each entry."""
    m = M.TiledMatrix(matrix(spark, np.ones((30, 30))))
    x = vector(spark, np.ones(30))
    assert m.products(x).count() == 30
    plan = plan_of(m.products(x)).split("\n")
    scan = next(k for k, line in enumerate(plan) if "tiles_" in line)
    deep = lambda k: len(plan[k]) - len(plan[k].lstrip(" :+-*()0123456789"))
    above = next(k for k in range(scan, -1, -1) if "FlatMapCoGroups" in plan[k])
    path = [k for k in range(above, scan) if deep(k) < deep(scan)]
    assert path and not any("Exchange" in plan[k] for k in path if deep(k) > deep(above) and all(deep(i) > deep(k) for i in range(k + 1, scan + 1)))
    m.drop()


def test_tiled_coupling(spark):
    """Tiles of pairs of lines make the products of the summed matrix, and errors are those of plain tables."""
    plain, (tiled, diagonal) = M.summed(Q.coupled(spark, SF)).cache(), Q.tiled_coupling(spark, SF)
    w = Q.samples(diagonal.select(F.col("i").alias("id")), 2)
    for mode in ("none", "transpose"):
        got, want = ({(r.vec, r.idx): r.re for r in M.apply_matrix(m, w, mode).collect()} for m in (tiled.scaled(0.5), plain))
        assert got.keys() == want.keys() and all(np.isclose(2 * got[k], v) for k, v in want.items())
    tiled.drop()


def test_basis_is_not_shuffled(spark):
    """The vectors of a cycle lie beside each other in one bucketed table; dots and combinations are those of numpy."""
    g = np.random.default_rng(11)
    w, image = g.normal(size=8) + 1j * g.normal(size=8), g.normal(size=8) + 1j * g.normal(size=8)
    basis = S._Basis(Scratch(spark, "basis-test"), vector(spark, w).withColumn("vec", F.col("vec").cast("long")))
    basis.advance({0: []}, {0: 0.5}, lambda v: vector(spark, image).withColumn("vec", F.col("vec").cast("long")))
    square, dots = basis.dots({0: [2j]})
    v = image - 2j * (0.5 * w)
    assert np.isclose(square[0], np.linalg.norm(v) ** 2) and np.allclose(dots[0], [np.vdot(0.5 * w, v)])
    assert np.allclose(as_array(basis.combined({0: np.array([3.0])}), 8), 1.5 * w)
    assert "Exchange" not in plan_of(basis.table.groupBy("vec", "idx").count())
    basis.drop()


def test_gmres_by_blocks(spark, monkeypatch):
    """Tiled matrices are applied to blocks of arrays: solutions and histories are those of plain products, over restarts, far ids and image-only ids."""
    monkeypatch.setattr(S, "BLOCK_NUMBERS", 1)
    g, n = np.random.default_rng(12), 24
    ids = np.sort(g.choice(np.arange(-900, 3000), n, replace=False))
    dense = (g.normal(size=(n, n)) + 1j * g.normal(size=(n, n))) * (g.random((n, n)) < 0.15) + np.diag(20 + g.random(n) * 9)
    entries = lambda m: spark.createDataFrame([(int(ids[i]), int(ids[j]), float(m[i, j].real), float(m[i, j].imag)) for i, j in np.argwhere(m)], "i long, j long, re double, im double")
    a, d = entries(dense), entries(np.diag(1 / np.diag(dense)))
    b = np.zeros((3, n), complex)
    b[0, :5], b[2] = 1, g.normal(size=n) + 1j * g.normal(size=n)
    rows = spark.createDataFrame([(v, int(ids[k]), float(b[v, k].real), float(b[v, k].imag)) for v in range(3) for k in range(5 if v == 0 else n)], "vec long, idx long, re double, im double")
    ta, td = M.TiledMatrix(a, 50), M.TiledMatrix(d, 50)
    for left, tiled in ((None, None), (lambda v: M.apply_matrix(d, v), td)):
        want, plain = S.gmres(lambda v: M.apply_matrix(a, v), rows, left, tolerance=1e-4, restart=3)
        got, history = S.gmres(ta, rows, tiled, tolerance=1e-4, restart=3)
        assert {v: len(h) for v, h in history.items()} == {v: len(h) for v, h in plain.items()} and all(np.allclose(h, plain[v], rtol=1e-6) for v, h in history.items())
        found = {(r.vec, r.idx): complex(r.re, r.im) for r in got.collect()}
        solution = np.linalg.solve(dense, b.T).T
        assert all(abs(found.get((v, int(ids[k])), 0) - solution[v, k]) < 1e-3 for v in (0, 2) for k in range(n)) and found.keys() == {(r.vec, r.idx) for r in want.collect()}
    basis = S._Arrays(Scratch(spark, "arrays-test"), rows, [ta])
    basis.advance({0: [], 2: []}, {0: 0.5, 2: 1.0})
    square, dots = basis.dots({0: [2j]})
    v = 0.5 * dense @ b[0] - 2j * 0.5 * b[0]
    assert np.isclose(square[0], np.linalg.norm(v) ** 2) and np.allclose(dots[0], [np.vdot(0.5 * b[0], v)])
    assert "Exchange" not in plan_of(basis.table.groupBy("block").count()) and basis.table.count() > 5
    for m in (basis, ta, td):
        m.drop()


def test_field_of_far_sources(spark):
    """Sources apart from the targets are put on fewer points with the same field; close, missing and infinite places are summed one by one."""
    g = np.random.default_rng(13)
    q, p, w = g.normal(size=(5000, 3)) * 0.004, np.r_[g.normal(size=(20, 3)) * 0.3 + [2, 0, 0], [[0.5, 0, 0]]], g.normal(size=5000) + 1j * g.normal(size=5000)
    rows = lambda at: [(i, *map(float, c)) for i, c in enumerate(at)]
    targets = spark.createDataFrame(rows(p), "id long, x double, y double, z double")
    sources = spark.createDataFrame([(*r, float(v.real), float(v.imag)) for r, v in zip(rows(q), w, strict=True)], "id long, x double, y double, z double, w_re double, w_im double")
    assert M.grid_sources(targets, sources, 2.0).count() < 2500
    d = np.linalg.norm(p[:, None] - q, axis=2)
    for name, kappa in (("helmholtz", 2.0), ("laplace", 0.0)):
        want = (np.exp(1j * kappa * d) / (4 * np.pi * d)) @ w
        got = {r.idx: complex(r.re, r.im) for r in M.field(targets, sources, name, kappa).collect()}
        assert np.allclose([got[i] for i in range(len(p))], want, rtol=0, atol=1e-13 * np.abs(w).sum() / (4 * np.pi * d.min()))
    for other in ((5.0, 0.0, None), (0.01, 0.0, 0.0), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0)):
        more = targets.unionByName(spark.createDataFrame([(99, *other)], targets.schema))
        assert M.grid_sources(more, sources, 2.0) is None
    close = M.field(spark.createDataFrame([(0, 0.01, 0.0, 0.0)], targets.schema), sources, "laplace", 0.0).first()
    assert np.isclose(complex(close.re, close.im), (w / (4 * np.pi * np.linalg.norm(q - [0.01, 0, 0], axis=1))).sum(), rtol=1e-10)
