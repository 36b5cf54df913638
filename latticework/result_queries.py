"""Queries on run results, histories, boxes, meshes and sample stores (the second half of queries.py)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import names as N
from latticework.functions import results as R
from latticework.functions.complex import cx
from latticework.operators import boxes as B
from latticework.operators import mesh as G
from latticework.operators import report as T
from latticework.operators.matrix import apply_matrix, checked, make_operator
from latticework.queries import PTS, SIDE, TV, gauss, hundred, ids, measured, points, query, r, rounded, rs, side, sparse, square, table
from latticework.session import Scratch
from latticework.sources import points as P
from latticework.sources import results as D
from latticework.sources import samples as A

# --- names and column rules ---


@query("""SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name || 'BigMesh', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake,
    CASE WHEN c_custkey = 0 THEN '0.00e0' ELSE regexp_replace(regexp_replace(format('{:.2e}', c_custkey / 7), 'e\\+0*([0-9])', 'e\\1'), 'e-0*([0-9])', 'e-\\1') END AS two, c_mktsegment || '_' || c_nationkey AS folder FROM customer""")
def scl5_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", N.camel_to_snake(F.concat("c_name", F.lit("BigMesh"))).alias("snake"), N.two_digits(F.col("c_custkey") / 7).alias("two"), N.folder(F.col("c_mktsegment"), F.lit(""), F.col("c_nationkey").cast("string")).alias("folder"))


def _two(x: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:.2e}}', {x}), 'e\\+0*([0-9])', 'e\\1'), 'e-0*([0-9])', 'e-\\1')"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS leveled, CASE WHEN c_custkey % 2 = 0 THEN 1.0 / (3 + c_custkey) ELSE c_custkey / 7 + 1.0 END AS a, (c_custkey % 5) / 4.0 AS b FROM customer), d AS (SELECT *, CASE WHEN leveled AND a >= 1 THEN 'ref_level_' || CAST(floor(a) AS BIGINT) || '_depth_' || CAST(floor(b) AS BIGINT) ELSE 'mesh_width_' || {_two("a")} END AS dim FROM c)
    SELECT k, 'sphere_surface_op_precision_double_' || dim || CASE WHEN leveled OR b = 0 THEN '' ELSE '_kappa_' || format('{{:.2f}}', b) END AS samples, 'results/sphere_surface_op_precision_double_' || dim || '_od_' || (k % 9) || CASE WHEN leveled THEN '' ELSE '_' || format('{{:.2f}}', b) END || '_num_threads_8/v1' AS run FROM d""")
def scl5_folder_keys(spark, sf_dir):
    """Keys of samples and folders of runs, by levels and by mesh width, with and without kappa."""
    k = F.col("c_custkey")
    a, b, leveled = F.when(k % 2 == 0, 1.0 / (3 + k)).otherwise(k / 7 + 1.0), (k % 5) / 4.0, k % 3 == 0
    kind = F.lit("SphereSurface"), F.lit("op"), F.lit("Double"), leveled, a, b
    return table(spark, sf_dir, "customer").select(k.alias("k"), N.sample_key(*kind).alias("samples"), N.run_folder(*kind, k % 9, F.lit(8), F.lit("v1")).alias("run"))


GEOMETRIES = ["Square", "SphereSurface", "CubeSurface", "CylinderSurface", "EllipsoidSurface", "Dihedral", "Device", "F16", "RidgedHorn", "EMCCAlmond", "FrigateHull", "Plane", "Sphere", "Cube"]


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS tolerance, {GEOMETRIES}[1 + l_suppkey % 14] AS geometry FROM lineitem)
    SELECT l_orderkey, l_linenumber, geometry, CASE WHEN tolerance < 1 THEN 50 WHEN geometry = 'Square' THEN 4 * floor(tolerance) WHEN geometry IN ('Sphere', 'Cube') THEN 8 * floor(tolerance) ELSE 6 * floor(tolerance) END::BIGINT AS leaf FROM g""")
def scl6_leaf_size(spark, sf_dir):
    geometry = F.array(*map(F.lit, GEOMETRIES))[(F.col("l_suppkey") % 14).cast("int")]
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("tolerance"), geometry.alias("geometry"))
    return own.select("l_orderkey", "l_linenumber", "geometry", R.leaf_size(F.col("tolerance"), F.col("geometry")).alias("leaf"))


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) % 7 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q) - 1 AS k FROM lineitem) SELECT l_orderkey, k, {r("CASE WHEN s = 0 THEN NULL ELSE 1 - q / s END", "compression")} FROM o""")
def scl7_compression(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).alias("s"))
    arrays = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s")).select("l_orderkey", F.transform("s", lambda x: x["q"]).alias("ranks"), F.transform("s", lambda x: x["q"] % 7).alias("sizes"))
    out = arrays.select("l_orderkey", F.posexplode(R.compression(F.col("ranks"), F.col("sizes"))).alias("k", "compression"))
    return rounded(out.select("l_orderkey", F.col("k").cast("long").alias("k"), "compression"))


@query(f"""SELECT o_orderkey, {rs({"rest": "greatest(o_totalprice - 100 * o_custkey, 0)", "kept": "CASE WHEN o_custkey % 2 > 0 THEN o_custkey % 2 ELSE greatest(o_totalprice - 100 * o_custkey, 0) END", "seconds": "o_totalprice / 1000.0"}, 6)} FROM orders""")
def scl8_untracked_time(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    spent = F.col("o_custkey") * 100.0
    return rounded(o.select("o_orderkey", R.untracked(F.col("o_totalprice"), spent).cast("double").alias("rest"), R.untracked(F.col("o_totalprice"), spent, (F.col("o_custkey") % 2).cast("double")).alias("kept"), (F.col("o_totalprice") / 1000.0).alias("seconds")), 6)


@query(f"""SELECT vec_id, {rs({"square": "a * a + b * b + c * c + d * d", "section": "10 * log10(4 * pi() * (a * a + b * b + c * c + d * d))"}, 8)} FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)""")
def scl9_magnitudes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    return rounded(e.select("vec_id", R.magnitude(cx(at(0), at(1)), cx(at(2), at(3))).alias("square")).withColumn("section", R.cross_section(F.col("square"))), 8)


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0) AS n_nonzero FROM lineitem WHERE l_discount IS NOT NULL AND NOT isnan(l_discount) GROUP BY 1""")
def scl10_valid_numbers(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").where(R.valid(F.col("l_discount")))
    return own.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0).alias("n_nonzero"))


@query(f"""SELECT l_orderkey, l_linenumber, {rs({"growth": "CASE WHEN l_tax = 0 THEN NULL ELSE power(1 + l_quantity * l_discount * l_tax, 2) END", "diagonal": "power(1 + l_quantity * CASE WHEN l_tax = 0 THEN 1 ELSE l_tax END, 2)"}, 6)} FROM lineitem""")
def scl11_growth(spark, sf_dir):
    up = F.nullif(F.col("l_tax"), F.lit(0.0))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.growth(F.col("l_quantity"), F.col("l_discount"), up).alias("growth"), R.diagonal_growth(F.col("l_quantity"), up).alias("diagonal")), 6)


@query(f"""SELECT {r("min(l_tax)", "least")}, {r("min(l_tax) FILTER (WHERE abs(l_tax - 0.05) <= 1e-8 + 1e-5 * 0.05)", "found")} FROM lineitem""")
def scl13_tolerance_lookup(spark, sf_dir):
    stats = table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("tolerance"))
    return rounded(T.at_tolerance(stats, None).select(F.col("tolerance").alias("least")).crossJoin(T.at_tolerance(stats, 0.05).select(F.col("tolerance").alias("found"))))


# --- documents made of events: one for each tolerance and block of event ids, so that none grows with the table ---

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
DOCS = f"e AS (SELECT {K} AS tolerance, event_id // 4096 AS block, event_id, user_id, event_type, value, row_number() OVER (PARTITION BY {K}, event_id // 4096 ORDER BY event_id) - 1 AS k FROM events)"
#: The phase of a document that an event's time belongs to.
PHASE = {"view": "lu", "click": "id"}


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumns({"tolerance": F.get_json_object("props", "$.k").cast("double"), "block": F.expr("event_id div 4096")})


def documents(spark, sf_dir):
    """tolerance, block, doc: a time document of the events of each tolerance and block."""
    own = events(spark, sf_dir).groupBy("tolerance", "block").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e"), F.count("*").alias("n"), F.max("user_id").alias("u"), F.sum("value").alias("t"))
    zero, none = F.lit(0.0), F.array()
    body = {"tot_num_samples": F.col("n"), "max_level": F.col("u"), "dim": 3 * F.col("n"), "sampling_time": F.transform("e", lambda x: x["event_id"]), "total_elapsed_time": F.lit(5), "total_elapsed_time_wo_sampling": F.col("t"), "extraction_time": zero, "sampling_extraction_time": zero,
            "id_times": F.transform("e", lambda x: F.struct(x["value"].alias("nullification"), (2 * x["value"]).alias("id"))), "tot_id_time": zero, "tot_lu_time": zero, "lu_times": none, "update_times": none, "index_calculation": zero, "sorting_near_field": zero, "residual_calculation": zero}
    return own.select("tolerance", "block", F.to_json(F.struct(*(v.alias(k) for k, v in body.items()))).alias("doc"))


@query(f"""WITH {DOCS} SELECT CAST(tolerance AS DOUBLE) AS tolerance, block, count(*) AS tot_num_samples, max(user_id) AS max_level, 3 * count(*) AS dim, {rs({"sampling": "sum(event_id)", "nullification": "sum(value)", "total": "5.0", "loading": "0.0"}, 6)}, 0::BIGINT AS n_snapshots FROM e GROUP BY ALL""")
def src2_typed_documents(spark, sf_dir):
    t = D.typed(documents(spark, sf_dir), "time")
    sums = {"sampling": F.col("sampling_time"), "nullification": F.transform("id_times", lambda x: x["nullification"])}
    added = [F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(n) for n, c in sums.items()]
    return rounded(t.select("tolerance", "block", "tot_num_samples", "max_level", "dim", *added, F.col("total_elapsed_time").alias("total"), F.col("sample_loading_time").alias("loading"), F.size("memory_snapshots").cast("long").alias("n_snapshots")), 6)


@query(f"""WITH {DOCS}, f AS (SELECT *, CASE event_type WHEN 'view' THEN 'lu' WHEN 'click' THEN 'id' ELSE 'dfactors' END AS family FROM e) SELECT CAST(tolerance AS DOUBLE) AS tolerance, family, CASE WHEN family <> 'dfactors' THEN CAST(user_id % 3 AS INTEGER) END AS level, count(*) AS n, {r("sum(value)", "cond", 6)}, {r("sum(value * 2)", "norm", 6)}, part FROM f, (VALUES ('rect'), ('L')) AS p(part) WHERE part = 'rect' OR event_id % 2 = 0 GROUP BY ALL""")
def src3_condition_rows(spark, sf_dir):
    """Elements [[cond, norm], null or [[cond, norm], null]]: of views and clicks by level (of users), of all other events in one list; then flattened and summed."""
    pair = F.format_string("[%s,%s]", F.col("value").cast("string"), (F.col("value") * 2).cast("string"))
    element = F.concat(F.lit("["), pair, F.lit(","), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), pair, F.lit(",null]"))).otherwise("null"), F.lit("]"))
    family = F.when(F.col("event_type") == "view", "lu").when(F.col("event_type") == "click", "id").otherwise("dfactors")
    keys = ["tolerance", "block", "family"]
    own = events(spark, sf_dir).select("tolerance", "block", family.alias("family"), F.when(family != "dfactors", F.col("user_id") % 3).alias("level"), F.concat(F.lit("["), element, F.lit("]")).alias("entry"))
    levels = own.groupBy(*keys, "level").agg(F.concat(F.lit("["), F.array_join(F.collect_list("entry"), ","), F.lit("]")).alias("x"))
    by_level = levels.groupBy(*keys).agg(F.max(F.when(F.col("level").isNull(), F.col("x"))).alias("flat"), *(F.coalesce(F.max(F.when(F.col("level") == k, F.col("x"))), F.lit("[]")).alias(f"l{k}") for k in range(3)))
    listed = by_level.select(*keys, F.coalesce("flat", F.format_string("[%s,%s,%s]", "l0", "l1", "l2")).alias("x"))
    of = lambda f: F.coalesce(F.max(F.when(F.col("family") == f, F.col("x"))), F.lit("[]"))
    docs = listed.groupBy("tolerance", "block").agg(F.format_string('{"id":%s,"lu":%s,"dfactors":%s}', of("id"), of("lu"), of("dfactors")).alias("doc"))
    rows = D.condition_rows(docs)
    return rounded(rows.groupBy("tolerance", "family", F.col("level").cast("int").alias("level"), "part").agg(F.count("*").alias("n"), F.sum("cond").alias("cond"), F.sum("norm").alias("norm")), 6)


@query(f"""WITH {DOCS} SELECT CAST(tolerance AS DOUBLE) AS tolerance, family, {r("sum(value)", "total", 6)}, count(*) AS n FROM (SELECT tolerance, value, 'id' AS family FROM e UNION ALL SELECT tolerance, value, 'diag' FROM e WHERE k < 2) GROUP BY ALL""")
def src4_block_error_rows(spark, sf_dir):
    own = events(spark, sf_dir).groupBy("tolerance", "block").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    values = F.transform("e", lambda x: x["value"])
    docs = own.select("tolerance", "block", F.to_json(F.struct(F.array(F.array(values)).alias("id_error_stats"), F.slice(values, 1, 2).alias("diag_error_stats"))).alias("doc"))
    return rounded(D.block_error_rows(docs).groupBy("tolerance", "family").agg(F.sum("value").alias("total"), F.count("*").alias("n")), 6)


@query(f"""SELECT vec_id AS vec, CAST(unnest(range(len(embedding))) AS BIGINT) AS idx, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS re, 0.0 AS im FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 2 = 0""")
def src5_solution_group(spark, sf_dir):
    own = measured(spark, sf_dir).withColumns({"tolerance": F.when(F.col("vec") % 2 == 0, 1e-2).otherwise(1e-4), "group": F.lit("sols_prec")})
    return rounded(D.solution_group(own, 1e-2).select("vec", F.col("idx").cast("long").alias("idx"), "re", "im"), 6)


@query(f"""SELECT count(*) AS n, {rs({"re": "sum(re)", "im": "sum(im)"}, 4)} FROM (SELECT CAST(embedding[1] AS DOUBLE) AS re, 0.0 AS im FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE) FROM embeddings WHERE vec_id % 2 = 1)""")
def src6_decode_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("a", "b"))))
    real = F.to_json(F.array("a"))
    pairs = F.to_json(F.array(F.array("a", "b")))
    return rounded(D.decode_vector(e.select(F.when(F.col("vec_id") % 2 == 0, real).otherwise(pairs).alias("values"))).agg(F.count("*").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im")), 4)


# --- summaries ---

LI = "SELECT l_returnflag, l_linestatus, {x} FROM lineitem GROUP BY 1, 2"
METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(LI.format(x=", ".join(f"{r(f'avg({m})', 'mean_' + m, 6)}, {r(f'stddev_pop({m})', 'std_' + m, 6)}" for m in METRICS)))
def agg1_mean_std(spark, sf_dir):
    return rounded(T.mean_std(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], METRICS), 6)


@query(f"""WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT o_custkey, {rs({"mean_rest": "avg(o_totalprice) FILTER (WHERE k > 1)", "last": "max(o_totalprice) FILTER (WHERE k = 1)"}, 8)} FROM o GROUP BY 1""")
def agg2_all_but_last(spark, sf_dir):
    return rounded(T.all_but_last(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice"), 8)


PHASES = "h AS (SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) AS id, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS lu, sum(value) AS total FROM events GROUP BY 1)"


def phases(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_type") == "view", "id").when(F.col("event_type") == "click", "lu")
    return T.phase_totals(e.select("user_id", phase.alias("phase"), "value"), "user_id", ["id", "lu"], e.groupBy("user_id").agg(F.sum("value").alias("total")))


@query(f"""WITH {PHASES} SELECT user_id, {rs({"total": "total", "id": "id", "lu": "lu", "other": "greatest(total - id - lu, 0)"}, 6)} FROM h""")
def agg3_phase_totals(spark, sf_dir):
    return rounded(phases(spark, sf_dir), 6)


@query(f"""WITH {PHASES}, u AS (SELECT user_id, 'id' AS phase, id AS value FROM h UNION ALL SELECT user_id, 'lu', lu FROM h UNION ALL SELECT user_id, 'other', greatest(total - id - lu, 0) FROM h) SELECT user_id, phase, {rs({"value": "value", "share": "value / sum(value) OVER (PARTITION BY user_id)"}, 6)} FROM u WHERE value > 0""")
def agg4_phase_shares(spark, sf_dir):
    return rounded(T.shares(phases(spark, sf_dir), "user_id", ["id", "lu", "other"], drop_zero=True), 6)


@query(LI.format(x=rs({"mean": "avg(l_extendedprice)", "median": "median(l_extendedprice)", "std": "stddev_pop(l_extendedprice)"}, 5)))
def agg5_level_summary(spark, sf_dir):
    return rounded(T.level_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 5)


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, {rs({"q1": "any_value(q1)", "median": "any_value(median)", "q3": "any_value(q3)", "whisker_low": "min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1))", "whisker_high": "max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1))"}, 6)}, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM events JOIN q USING (event_type) GROUP BY 1""")
def agg6_box_plot(spark, sf_dir):
    return rounded(T.box_plot(table(spark, sf_dir, "events"), ["event_type"], "value"), 6)


def case_metrics(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("case"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("v"))
    return n.join(c, "n_nationkey").select("case", F.lit("balance").alias("metric"), "v").unionByName(n.join(s, "n_nationkey").select("case", F.lit("suppliers").alias("metric"), "v")).withColumnRenamed("v", "value")


@query("""WITH b AS (SELECT n_name AS name, (SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS a, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation), f AS (SELECT name, (a IS NULL OR a >= 4500) AS fa, s <> 4 AS fs FROM b)
    SELECT name AS "case", CAST(fa AS INTEGER) + CAST(fs AS INTEGER) AS n_failed, CASE WHEN fa AND fs THEN 'balance,suppliers' WHEN fa THEN 'balance' WHEN fs THEN 'suppliers' ELSE '' END AS failed, CASE WHEN fa OR fs THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f""")
def agg12_gate(spark, sf_dir):
    case = table(spark, sf_dir, "nation").select(F.col("n_name").alias("case"))
    limits = case.select("case", F.lit("balance").alias("metric"), F.lit(4500.0).alias("max_value"), F.lit(None).cast("long").alias("expected")).unionByName(case.select("case", F.lit("suppliers").alias("metric"), F.lit(None).cast("double").alias("max_value"), F.lit(4).cast("long").alias("expected")))
    return T.gate(case_metrics(spark, sf_dir), limits)


@query("""WITH m AS (SELECT c_nationkey AS n, max(c_acctbal) AS f, avg(c_acctbal) AS t, max(c_acctbal) FILTER (WHERE c_custkey % 2 = 1) AS af, CASE WHEN count(*) % 5 > 0 THEN min(c_acctbal) END AS e2 FROM customer GROUP BY 1), k AS (SELECT n_name, f, t, t - 4500 AS a, af, e2, f IS NOT NULL AND t IS NOT NULL AND af IS NOT NULL AS ok FROM nation LEFT JOIN m ON n = n_nationkey)
    SELECT n_name AS "case", concat_ws(',', CASE WHEN NOT ok THEN 'norms_present' END, CASE WHEN ok AND NOT t < f THEN 'norm_2_below_norm_fro' END, CASE WHEN ok AND NOT a > 0 THEN 'norm_a_2_positive' END, CASE WHEN ok AND a > 0 AND t >= 20 * a THEN 'relative_norm_2' END, CASE WHEN e2 IS NULL OR f IS NULL THEN 'solve_errors_present' END) AS failed FROM k""")
def agg12_cross_rules(spark, sf_dir):
    odd = F.when(F.col("c_custkey") % 2 == 1, F.col("c_acctbal"))
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_acctbal").alias("norm_apply_fro"), F.avg("c_acctbal").alias("norm_apply_2"), F.max(odd).alias("norm_a_fro"), F.when(F.count("*") % 5 > 0, F.min("c_acctbal")).alias("err_solve_2"), F.max("c_acctbal").alias("err_solve_fro"))
    own = table(spark, sf_dir, "nation").join(m, "n_nationkey", "left").withColumn("norm_a_2", F.col("norm_apply_2") - 4500)
    return T.cross_rules(own.withColumnRenamed("n_name", "case"), 20.0)


RHS = "CASE event_type WHEN 'view' THEN event_id % 2 WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"


def histories(spark, sf_dir):
    """tolerance (user), curve, rhs, step, residual: views are unpreconditioned, a right-hand side for each parity of the id; each other type is a preconditioned one."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("tolerance"), F.when(F.col("event_type") == "view", "no_prec").otherwise("prec").alias("curve"), F.expr(RHS).alias("rhs"), "ts", "event_id", F.col("value").alias("residual"))
    step = F.row_number().over(Window.partitionBy("tolerance", "curve", "rhs").orderBy("ts", "event_id")) - 1
    return e.withColumn("step", step).drop("ts", "event_id")


HIST = f"g AS (SELECT user_id, event_type = 'view' AS plain, {RHS} AS rhs, count(*) AS n FROM events GROUP BY 1, 2, 3)"


@query(f"""WITH {HIST}, m AS (SELECT user_id, avg(n) FILTER (WHERE plain) AS a, avg(n) FILTER (WHERE NOT plain) AS b, count(*) FILTER (WHERE plain) AS c, count(*) FILTER (WHERE NOT plain) AS d FROM g GROUP BY 1)
    SELECT CAST(c_custkey AS DOUBLE) AS tolerance, {rs({"mean_no_prec": "a", "mean_prec": "b", "solve_error_rhs": "c_acctbal"})}, coalesce(c, 0) AS n_no_prec, coalesce(d, 0) AS n_prec, CAST(NULL AS DOUBLE) AS app_condition_number, {r("c_acctbal / 2", "norm_apply_2")}, {r("c_acctbal / 4", "err_solve_2")} FROM customer LEFT JOIN m ON user_id = c_custkey""")
def agg13_iteration_summary(spark, sf_dir):
    errors = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("tolerance"), F.col("c_acctbal").alias("solve_error_rhs"), (F.col("c_acctbal") / 2).alias("norm_apply_2"), (F.col("c_acctbal") / 4).alias("err_solve_2"))
    return rounded(T.iteration_summary(histories(spark, sf_dir), errors))


SERIES = {"norm_apply_2": "avg(l_extendedprice)", "err_solve_2": "avg(l_discount)", "cond_rsrs_estimate": "max(l_extendedprice)", "tot_num_samples": "count(*)", "residual_size": "max(l_quantity)"}


@query(" UNION ALL ".join(f"""SELECT CAST({k} AS INTEGER) AS metric, '{n}' AS name, CAST(l_linenumber AS DOUBLE) AS tolerance, {r(f"CAST({e} AS DOUBLE)", "value", 5)} FROM lineitem GROUP BY 3""" for k, (n, e) in enumerate(SERIES.items(), 1)))
def agg14_metric_series(spark, sf_dir):
    """All five metrics, by number; each from the column of its name."""
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("tolerance")).agg(*(F.expr(e).alias(n) for n, e in SERIES.items()))
    each = [T.metric_series(stats, k).select(F.lit(k).alias("metric"), F.lit(n).alias("name"), "tolerance", "value") for k, n in enumerate(SERIES, 1)]
    return rounded(reduce(DataFrame.unionByName, each), 5)


@query(f"""WITH {DOCS} SELECT CAST(tolerance AS DOUBLE) AS tolerance, {r("sum(value) / 1000", "value")} FROM e GROUP BY tolerance, block""")
def agg14_elapsed_seconds(spark, sf_dir):
    return rounded(T.elapsed_seconds(D.typed(documents(spark, sf_dir), "time")))


@query(f"""SELECT CAST({RHS} AS VARCHAR) AS method, CAST(user_id AS DOUBLE) AS tolerance, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2""")
def agg14_iteration_series(spark, sf_dir):
    h = histories(spark, sf_dir)
    return T.iteration_series(h.select("tolerance", F.when(F.col("curve") == "prec", F.col("rhs").cast("string")).otherwise("no_prec").alias("method"), "residual"))


@query(f"""WITH {DOCS} SELECT 3 * count(*) AS dim FROM e WHERE tolerance = (SELECT min(tolerance) FROM e)""")
def agg14_degrees_of_freedom(spark, sf_dir):
    t = D.typed(documents(spark, sf_dir), "time").groupBy("tolerance").agg(F.sum("dim").alias("dim"))
    return T.degrees_of_freedom(t)


@query(f"""WITH {PTS}, b AS (SELECT min(x) AS min_x, max(x) AS max_x, avg(x) AS mean_x, min(y) AS min_y, max(y) AS max_y, avg(y) AS mean_y, min(z) AS min_z, max(z) AS max_z, avg(z) AS mean_z FROM p), q AS (SELECT sqrt(max((x - mean_x) ** 2 + (y - mean_y) ** 2 + (z - mean_z) ** 2)) AS radius FROM p, b)
    SELECT {rs({**{f"{n}_{c}": f"{n}_{c}" for c in "xyz" for n in ("min", "max", "mean")}, "radius": "radius", "diagonal": "sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2)"})} FROM b, q""")
def agg16_extent(spark, sf_dir):
    return rounded(T.extent(points(spark, sf_dir)))


CUT = "q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events), s AS (SELECT event_id, lo, hi, least(greatest(value, lo), hi) AS v FROM events, q)"


@query(f"""WITH {CUT} SELECT event_id, {rs({"linear": "(v - lo) / (hi - lo)", "root": "power((v - lo) / (hi - lo), 0.5)", "log": "ln(greatest(v, greatest(lo, greatest(1e-12 * hi, 1e-300))) / greatest(lo, greatest(1e-12 * hi, 1e-300))) / ln(hi / greatest(lo, greatest(1e-12 * hi, 1e-300)))"}, 7)} FROM s""")
def agg17_contrast(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    limits = Scratch(spark, "contrast").table(T.contrast_range(e, "value"), "limits")
    for name, how in (("linear", "linear"), ("root", "power"), ("log", "log")):
        e = T.contrast(e, "value", how=how, limits=limits).withColumnRenamed("scaled", name)
    return rounded(e.drop("value"), 7)


@query(f"""SELECT {rs({"low": "min(value)", "high": "max(value)"}, 6)} FROM events WHERE isfinite(value)""")
def agg17_shared_range(spark, sf_dir):
    return rounded(T.shared_range(table(spark, sf_dir, "events"), "value"), 6)


SNAP = {"total_bytes": "event_id % 97", "id_bytes": "event_id % 10", "lu_bytes": "event_id % 7", "diag_bytes": "event_id % 5", "perm_bytes": "event_id % 3", "id_count": "event_id % 11", "lu_count": "event_id % 13", "diag_count": "event_id % 17"}


@query("SELECT user_id, count(*) AS n_snapshots, max(event_id) AS max_rss, max(2 * event_id) AS max_peak, max(event_id % 10 + event_id % 7) AS max_id_lu, " + ", ".join(f"max({e}) AS max_{n}" for n, e in SNAP.items()) + " FROM events GROUP BY 1")
def agg19_memory_report(spark, sf_dir):
    e = F.col("event_id")
    factors = F.struct(*(F.expr(x).alias(n) for n, x in SNAP.items()))
    return T.memory_report(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), e.alias("rss_bytes"), (2 * e).alias("peak_rss_bytes"), factors.alias("factor_memory")), "user_id")


MODES = "CASE l_linestatus WHEN 'O' THEN 'none' ELSE 'transpose' END"


@query(f"""WITH w AS (SELECT l_suppkey AS factor, {MODES} AS mode, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS mode_order, l_discount AS defect FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY defect DESC, mode_order) AS k FROM w) SELECT factor, CASE WHEN defect > 0 THEN mode ELSE '' END AS mode, {r("defect", "defect")} FROM k WHERE k = 1""")
def agg20_worst_route(spark, sf_dir):
    plain = F.col("l_linestatus") == "O"
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("factor"), F.when(plain, "none").otherwise("transpose").alias("mode"), F.when(plain, 0).otherwise(1).alias("mode_order"), F.col("l_discount").alias("defect"))
    return rounded(T.worst_route(own))


PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""WITH v AS (SELECT CAST(o_custkey % 400 AS BIGINT) AS n, o_orderpriority AS p, count(*) AS c FROM orders GROUP BY 1, 2) SELECT n, """ + ", ".join(f"""coalesce(CAST(max(c) FILTER (WHERE p = '{p}') AS VARCHAR), '--') AS "{p}" """ for p in PRIO) + " FROM v GROUP BY n")
def agg22_comparison(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 400).alias("n"), "o_orderpriority").agg(F.count("*").alias("c"))
    return T.comparison(own, "n", "o_orderpriority", "c", PRIO, "%d")


@query("""WITH v AS (SELECT o_orderpriority AS p, o_custkey % 50 AS k, year(o_orderdate) AS y, avg(o_totalprice) AS a FROM orders GROUP BY 1, 2, 3), o AS (SELECT p, k, y + 1 AS y, a FROM v) SELECT coalesce(o.p, n.p) AS p, coalesce(o.k, n.k) AS k, CAST(coalesce(o.y, n.y) AS INTEGER) AS y, """ + rs({"old": "o.a", "new": "n.a"}, 7) + ", coalesce(o.a >= 1.2 * n.a, false) AS improved FROM o FULL JOIN v n ON o.p = n.p AND o.k = n.k AND o.y = n.y")
def agg22_improved(spark, sf_dir):
    """Each year's means against those of the year before."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 50).alias("k"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("a"))
    return rounded(T.improved(v.withColumn("y", F.col("y") + 1), v, ["p", "k", "y"], "a", 1.2), 7)


# --- windows and orders ---


@query(f"""SELECT event_type, event_id, {r("value", "value", 6)}, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place FROM events""")
def win1_sorted_index(spark, sf_dir):
    return rounded(T.sorted_index(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id"), 6)


XM = "m AS (SELECT vec_id AS vec, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), e AS (SELECT vec, idx, v * v / greatest(sum(v * v) OVER (PARTITION BY vec), 1e-30) AS energy FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY vec ORDER BY energy DESC, idx) AS rank FROM e)"


@query(f"""WITH {XM} SELECT vec, {rs({"top_10": "sum(energy) FILTER (WHERE rank <= 10)", "top_25": "sum(energy) FILTER (WHERE rank <= 25)"}, 8)} FROM k GROUP BY 1""")
def win2_top_energy(spark, sf_dir):
    return rounded(T.top_energy(measured(spark, sf_dir)), 8)


@query(f"""WITH h AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'no_prec' ELSE 'prec' END AS curve, {RHS} AS rhs, ts, event_id, value FROM events), f AS (SELECT *, min(rhs) OVER (PARTITION BY user_id, curve) AS first, row_number() OVER (PARTITION BY user_id, curve, rhs ORDER BY ts, event_id) - 1 AS step FROM h)
    SELECT CAST(user_id AS DOUBLE) AS tolerance, curve, CAST(step AS INTEGER) AS step, {r("value", "residual", 6)} FROM f WHERE rhs = first AND (curve = 'prec' OR user_id = (SELECT min(user_id) FROM f WHERE curve = 'no_prec'))""")
def win3_residual_curves(spark, sf_dir):
    return rounded(T.residual_curves(histories(spark, sf_dir)), 6)


@query("""SELECT CAST(l_discount AS DOUBLE) AS tolerance, count(*) AS n FROM lineitem GROUP BY 1""")
def srt1_by_tolerance(spark, sf_dir):
    return T.by_tolerance(table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("tolerance")).agg(F.count("*").alias("n")))


@query("""WITH f AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'slice_' || p_partkey || '.txt' WHEN p_partkey % 3 = 1 THEN 'p' || p_partkey || '_sum.txt' ELSE 'mean' || p_partkey || '.txt' END AS name FROM part) SELECT name, CASE WHEN name LIKE 'slice%' THEN 0 WHEN name LIKE '%\\_sum.txt' ESCAPE '\\' THEN 1 ELSE 2 END AS kind, CASE WHEN name LIKE 'slice%' THEN CAST(regexp_extract(name, '_([0-9]+)', 1) AS INTEGER) ELSE -1 END AS number FROM f""")
def srt3_slice_order(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("slice_"), k, F.lit(".txt"))).when(k % 3 == 1, F.concat(F.lit("p"), k, F.lit("_sum.txt"))).otherwise(F.concat(F.lit("mean"), k, F.lit(".txt")))
    return T.slice_order(table(spark, sf_dir, "part").select(name.alias("name")).distinct())


@query(f"""SELECT idx, {rs({"re": "sum(v)", "im": "0.0"}, 6)} FROM (SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL) GROUP BY 1""")
def set1_coherent_sum(spark, sf_dir):
    from latticework.operators.matrix import coherent_sum

    m = measured(spark, sf_dir)
    return rounded(coherent_sum(*(m.where(F.col("vec") % 2 == k).select("idx", "re", "im") for k in (0, 1))), 6)


# --- boxes ---

DEPTH = 4


def _key(level_bits):
    return " | ".join(f"((({c} >> {b}) & 1) << {3 * b + a})" for b in range(level_bits) for a, c in enumerate(("ix", "iy", "iz")))


BOX = f"""{PTS}, lo AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM p), l AS (SELECT unnest(range({DEPTH + 1})) AS level),
    b0 AS (SELECT id, level, least(CAST(floor((x - lx) / side * (1 << level)) AS BIGINT), (1 << level) - 1) AS ix, least(CAST(floor((y - ly) / side * (1 << level)) AS BIGINT), (1 << level) - 1) AS iy, least(CAST(floor((z - lz) / side * (1 << level)) AS BIGINT), (1 << level) - 1) AS iz FROM p, lo, l),
    b AS (SELECT *, {_key(DEPTH)} AS key FROM b0), c AS (SELECT level, key, ix, iy, iz, count(*) AS n FROM b GROUP BY ALL), f AS (SELECT b.id, b.level, b.key, row_number() OVER (PARTITION BY b.id ORDER BY b.level) AS k FROM b JOIN c ON c.level = b.level AND c.key = b.key WHERE c.n <= 20 OR b.level = {DEPTH}), leaf AS (SELECT id, level, key FROM f WHERE k = 1)"""
NEAR = "near AS (SELECT a.level, a.key, b.key AS other FROM c a JOIN c b ON b.level = a.level AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND a.key <> b.key)"


def boxes(spark, sf_dir):
    scratch = Scratch(spark, "boxes")
    fine = scratch.table(B.finest_boxes(points(spark, sf_dir), DEPTH), "fine")
    return fine, scratch.table(B.box_counts(fine, DEPTH), "counts")


def leaves(spark, sf_dir):
    fine, counts = boxes(spark, sf_dir)
    return B.leaves(fine, B.leaf_boxes(counts, 20, DEPTH), DEPTH)


@query(f"""WITH {BOX} SELECT id, CAST(level AS INTEGER) AS level, CAST(key AS BIGINT) AS key FROM leaf""")
def itr3_octree_leaves(spark, sf_dir):
    return leaves(spark, sf_dir)


@query(f"""WITH {BOX} SELECT count(*) AS n_leaves, CAST(max(level) AS INTEGER) AS max_level, max(n) AS max_points FROM (SELECT level, key, count(*) AS n FROM leaf GROUP BY ALL)""")
def itr3_leaf_summary(spark, sf_dir):
    return B.leaf_summary(B.leaf_boxes(boxes(spark, sf_dir)[1], 20, DEPTH))


@query(f"""WITH {BOX} SELECT CAST(level AS INTEGER) AS level, CAST(key AS BIGINT) AS key, {r("sum(power(" + TV.format(o=0) + ", 2))", "energy", 8)} FROM leaf GROUP BY ALL""")
def joi3_leaf_energy(spark, sf_dir):
    return rounded(B.leaf_energy(leaves(spark, sf_dir), P.test_vector(ids(spark, sf_dir))), 8)


@query(f"""WITH {BOX} SELECT CAST(level AS INTEGER) AS level, CAST(key AS BIGINT) AS key, {r("sum(power(" + TV.format(o=0) + ", 2))", "energy", 8)} FROM leaf GROUP BY ALL ORDER BY sum(power({TV.format(o=0)}, 2)) DESC, key LIMIT 5""")
def srt2_top_leaves(spark, sf_dir):
    return rounded(B.leaf_energy(leaves(spark, sf_dir), P.test_vector(ids(spark, sf_dir))).orderBy(F.desc("energy"), "key").limit(5), 8)


@query(f"""WITH {BOX}, {NEAR} SELECT CAST(level AS INTEGER) AS level, CAST(key AS BIGINT) AS key, CAST(other AS BIGINT) AS other FROM near""")
def joi6_neighbours(spark, sf_dir):
    return B.neighbours(boxes(spark, sf_dir)[1])


ACT = "".join(f", a{k} AS (SELECT key >> 3 AS key, CAST(sum(least(8, act)) AS BIGINT) AS act FROM a{k + 1} GROUP BY 1)" for k in range(DEPTH - 1, -1, -1))
ACTIVE = f"{BOX}, a{DEPTH} AS (SELECT key, n AS act FROM c WHERE level = {DEPTH}){ACT}, act AS (" + " UNION ALL ".join(f"SELECT {k} AS level, key, act FROM a{k}" for k in range(DEPTH + 1)) + ")"


@query(f"""WITH {ACTIVE}, {NEAR} SELECT a.level, CAST(a.key AS BIGINT) AS key, CAST(a.act + coalesce((SELECT sum(o.act) FROM near n JOIN act o ON o.level = n.level AND o.key = n.other WHERE n.level = a.level AND n.key = a.key), 0) + least(8, a.act) + 4 AS BIGINT) AS s FROM act a""")
def itr4_sample_rule(spark, sf_dir):
    active = B.active_counts(boxes(spark, sf_dir)[1], DEPTH, 8)
    return B.sample_rule(active, 8, 4)


@query(f"""WITH {ACTIVE} SELECT level, CAST(key AS BIGINT) AS key, act FROM act WHERE act > 8""")
def flt1_launch_mask(spark, sf_dir):
    return B.launched(B.active_counts(boxes(spark, sf_dir)[1], DEPTH, 8), 8).select("level", "key", "act")


@query(f"""WITH {ACTIVE}, t AS (SELECT * FROM act WHERE level > 0), {NEAR}, s AS (SELECT a.level, a.act + coalesce((SELECT sum(o.act) FROM near n JOIN act o ON o.level = n.level AND o.key = n.other WHERE n.level = a.level AND n.key = a.key), 0) + least(8, a.act) + 4 AS s FROM t a)
    SELECT CAST(max(s) AS BIGINT) AS s_max, CAST(least(max(s), 2 * (SELECT max(act) FROM act WHERE level = 0) + 8) AS BIGINT) AS s_0 FROM s""")
def itr4_sample_counts(spark, sf_dir):
    return B.sample_counts(B.active_counts(boxes(spark, sf_dir)[1], DEPTH, 8), 8, 4)


@query(f"""WITH RECURSIVE {BOX}, {NEAR}, o AS MATERIALIZED (SELECT level, key, row_number() OVER (PARTITION BY level ORDER BY key) AS k FROM c), e AS (SELECT level, key, other FROM near UNION ALL SELECT level, key, key FROM c),
    held AS MATERIALIZED (SELECT x.level, x.k, list(DISTINCT y.k) AS before FROM o x JOIN e p ON p.level = x.level AND p.key = x.key JOIN e q ON q.level = p.level AND q.other = p.other JOIN o y ON y.level = q.level AND y.key = q.key WHERE y.k < x.k GROUP BY ALL),
    g(level, k, colours) AS (SELECT DISTINCT level, 0::BIGINT, []::INTEGER[] FROM o UNION ALL SELECT g.level, g.k + 1, list_append(g.colours, CAST(list_min(list_filter(range(len(coalesce(held.before, [])) + 1), lambda v: NOT list_contains(list_transform(coalesce(held.before, []), lambda b: g.colours[b]), v))) AS INTEGER)) FROM g JOIN o ON o.level = g.level AND o.k = g.k + 1 LEFT JOIN held ON held.level = g.level AND held.k = g.k + 1)
    SELECT CAST(o.level AS INTEGER) AS level, CAST(o.key AS BIGINT) AS key, g.colours[o.k] AS colour FROM o JOIN g ON g.level = o.level AND g.k = o.k""")
def itr5_colours(spark, sf_dir):
    """The boxes of every level."""
    c = boxes(spark, sf_dir)[1]
    return B.colours(c.select("level", "key"), B.neighbours(c))


# --- meshes ---

MESH = f"""{PTS}, {SIDE}, g AS (SELECT n, unnest(range(n * n)) AS id FROM n), v AS (SELECT g.id AS vid, (2 + cos(2 * pi() * (g.id % n) / n)) * cos(2 * pi() * (g.id // n) / n) + 0.1 * coalesce(p.x, 0) AS x, (2 + cos(2 * pi() * (g.id % n) / n)) * sin(2 * pi() * (g.id // n) / n) + 0.1 * coalesce(p.y, 0) AS y, sin(2 * pi() * (g.id % n) / n) + 0.1 * coalesce(p.z, 0) AS z FROM g LEFT JOIN p ON p.id = g.id),
    t AS (SELECT 2 * id AS eid, id AS a, ((id // n + 1) % n) * n + id % n AS b, (id // n) * n + (id % n + 1) % n AS c FROM g UNION ALL SELECT 2 * id + 1, ((id // n + 1) % n) * n + id % n, ((id // n + 1) % n) * n + (id % n + 1) % n, (id // n) * n + (id % n + 1) % n FROM g),
    w AS (SELECT eid, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS "by", q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz FROM t JOIN v p ON p.vid = a JOIN v q ON q.vid = b JOIN v s ON s.vid = c)"""
EDGES = "d AS (SELECT eid, least(s, e) AS p, greatest(s, e) AS q, CASE WHEN s < e THEN 1 ELSE -1 END AS way FROM (SELECT eid, a AS s, b AS e FROM t UNION ALL SELECT eid, b, c FROM t UNION ALL SELECT eid, c, a FROM t))"


def mesh(spark, sf_dir):
    """A torus with as many vertices as there are points, about; each moved by a tenth of the point of its number."""
    n = side(spark, sf_dir)
    v, e = G.torus(spark, n, n)
    p = points(spark, sf_dir).select(F.col("id").alias("vid"), *(F.col(c).alias(f"d{c}") for c in "xyz"))
    return v.join(p, "vid", "left").select("vid", *((F.col(c) + 0.1 * F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz")), e


@query(f"""WITH {MESH} SELECT eid, {rs({"x": "(ax + bx + cx) / 3", "y": '(ay + "by" + cy) / 3', "z": "(az + bz + cz) / 3"})} FROM w""")
def src19_barycentres(spark, sf_dir):
    return rounded(G.barycentres(*mesh(spark, sf_dir)))


@query(f"""WITH {MESH}, {EDGES} SELECT DISTINCT p, q, {rs({"x": "(i.x + j.x) / 2", "y": "(i.y + j.y) / 2", "z": "(i.z + j.z) / 2"})} FROM d JOIN v i ON i.vid = p JOIN v j ON j.vid = q""")
def src19_edge_midpoints(spark, sf_dir):
    return rounded(G.edge_midpoints(*mesh(spark, sf_dir)))


@query(f"""WITH {MESH} SELECT eid, {rs({"ax": "ax", "by": '"by"', "cz": "cz"})} FROM w""")
def joi4_element_corners(spark, sf_dir):
    return rounded(G.with_corners(*mesh(spark, sf_dir)).select("eid", "ax", "by", "cz"))


@query(f"""WITH {MESH}, {EDGES}, e AS (SELECT p, q, count(*) AS n, sum(way) AS way FROM d GROUP BY 1, 2) SELECT count(*) FILTER (WHERE n = 1) AS n_boundary, count(*) FILTER (WHERE n > 2) AS n_nonmanifold, count(*) FILTER (WHERE n = 2 AND way <> 0) AS n_same_way, (SELECT round(sum(ax * ("by" * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - "by" * cx)) / 6, 7) + 0.0 FROM w) AS volume, true AS closed FROM e""")
def joi8_manifold_report(spark, sf_dir):
    return rounded(G.manifold_report(*mesh(spark, sf_dir)), 7)


@query(f"""WITH {MESH} SELECT eid, {r("(ax + bx + cx) / 3", "value")} FROM w""")
def agg18_vertex_means(spark, sf_dir):
    v, e = mesh(spark, sf_dir)
    return rounded(G.vertex_means(e, v.select("vid", F.col("x").alias("value"))))


@query(f"""WITH RECURSIVE {MESH}, {EDGES}, u AS MATERIALIZED (SELECT t.eid FROM t JOIN p ON p.id = t.a WHERE p.x <= 0.05), l AS MATERIALIZED (SELECT DISTINCT x.eid AS a, y.eid AS b FROM d x JOIN d y ON x.p = y.p AND x.q = y.q AND x.eid <> y.eid WHERE x.eid IN (SELECT eid FROM u) AND y.eid IN (SELECT eid FROM u)),
    z(a, b) AS (SELECT eid, eid FROM u UNION SELECT z.a, l.b FROM z JOIN l ON l.a = z.b), k AS (SELECT a AS eid, min(b) AS component FROM z GROUP BY 1) SELECT eid, component FROM k WHERE component IN (SELECT component FROM k GROUP BY 1 HAVING count(*) >= 10)""")
def itr6_mesh_components(spark, sf_dir):
    """The elements whose first corner belongs to a point with a small first coordinate fall apart into components; those of ten or more."""
    low = points(spark, sf_dir).where("x <= 0.05").select(F.col("id").alias("a"))
    return G.mesh_components(mesh(spark, sf_dir)[1].join(low.hint("merge"), "a", "left_semi"), 10)


def _clip(c: str, at: float) -> str:
    """SQL: the part of a polygon poly with s * (coordinate - at) >= 0: its corners inside, and where its edges cross the plane."""
    p, q = "poly[i]", "poly[i % len(poly) + 1]"
    point = ", ".join(f"'{k}': {p}.{k} + ({p}.{c} - {at}) / ({p}.{c} - {q}.{c}) * ({q}.{k} - {p}.{k})" for k in "xyz")
    return f"flatten(list_transform(range(1, len(poly) + 1), lambda i: list_concat(CASE WHEN s * ({p}.{c} - {at}) >= 0 THEN [{p}] ELSE [] END, CASE WHEN ({p}.{c} - {at}) * ({q}.{c} - {at}) < 0 THEN [{{{point}}}] ELSE [] END)))"


def _vector_area(a: str, b: str) -> str:
    """SQL: a component of the vector area of a polygon poly, doubled."""
    return f"list_sum(list_transform(range(1, len(poly) + 1), lambda i: poly[i].{a} * poly[i % len(poly) + 1].{b} - poly[i].{b} * poly[i % len(poly) + 1].{a}))"


@query(f"""WITH {MESH}, o AS (SELECT eid, [{{'x': ax, 'y': ay, 'z': az}}, {{'x': bx, 'y': "by", 'z': bz}}, {{'x': cx, 'y': cy, 'z': cz}}] AS poly FROM w), y AS (SELECT eid, s AS sy, {_clip("y", 0.123)} AS poly FROM o, (VALUES (1), (-1)) AS h(s)), q AS (SELECT eid, sy, s AS sz, {_clip("z", 0.045)} AS poly FROM y, (VALUES (1), (-1)) AS h(s) WHERE len(poly) >= 3)
    SELECT eid, CAST(CASE WHEN sy = 1 AND sz = 1 THEN 0 WHEN sy = -1 AND sz = 1 THEN 1 WHEN sy = -1 THEN 2 ELSE 3 END AS INTEGER) AS quadrant, {r(f"sqrt(power({_vector_area('x', 'y')}, 2) + power({_vector_area('y', 'z')}, 2) + power({_vector_area('z', 'x')}, 2)) / 2", "area", 8)}, len(poly) - 2 AS parts FROM q WHERE len(poly) >= 3""")
def itr7_quadrant_clip(spark, sf_dir):
    """Number and area of an element's pieces by quadrant."""
    v, e = mesh(spark, sf_dir)
    return rounded(G.area(G.quadrant_clip(v, e, 0.123, 0.045)).groupBy("eid", "quadrant").agg(F.sum("area").alias("area"), F.count("*").alias("parts")), 8)


# --- sample stores, plug-ins and writers ---


@query(f"""WITH h AS (SELECT DISTINCT l_partkey % 100 AS id FROM lineitem), a AS (SELECT l_suppkey % 100 AS i, l_partkey % 100 AS j, sum(l_quantity) AS re, sum(l_discount) AS im FROM lineitem GROUP BY 1, 2), w AS (SELECT CAST(s AS BIGINT) AS sample, id AS idx, {gauss(42, "s", "id")} AS re, {gauss(42, "s", "id", "i")} AS im FROM h, (SELECT unnest(range(6)) AS s)) SELECT kind, w.sample, a.i AS idx, {rs({"re": "sum(a.re * w.re - CASE kind WHEN 'real' THEN 0 ELSE a.im * w.im END)", "im": "sum(a.im * w.re + CASE kind WHEN 'real' THEN 0 ELSE a.re * w.im END)"}, 6)} FROM a JOIN w ON w.idx = a.j, (VALUES ('real'), ('complex')) AS k(kind) GROUP BY 1, 2, 3""")
def snk5_ensure_samples(spark, sf_dir):
    """Two samples, then four more: the stores have the images of six draws, real or complex."""
    a, h = square(spark, sf_dir), hundred(spark, sf_dir)
    out = []
    for kind in ("real", "complex"):
        folder = Scratch(spark, "store").top
        for wanted in (2, 6, 5):
            A.ensure_samples(h, wanted, folder, lambda x, mode: apply_matrix(a, x, mode), complex_values=kind == "complex")
        out.append(A.read_samples(spark, "y_sketch", folder).withColumn("kind", F.lit(kind)))
    return rounded(reduce(DataFrame.unionByName, out), 6)


@query(f"""WITH e AS (SELECT vec_id AS sample, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS re FROM embeddings WHERE embedding IS NOT NULL) SELECT base, sample, idx, {rs({"re": "CASE base WHEN 'y_test' THEN re ELSE -re END", "im": "CASE base WHEN 'y_test' THEN 0 ELSE 2 * re END"})} FROM e, (VALUES ('y_test'), ('z_sketch')) AS b(base)""")
def snk3_written_samples(spark, sf_dir):
    """Two bases, one of them written again with other values; both as they then are."""
    folder = Scratch(spark, "store").top
    own = measured(spark, sf_dir).select(F.col("vec").alias("sample"), F.col("idx").cast("long").alias("idx"), "re", "im")
    turned = own.withColumns({"re": -F.col("re"), "im": 2 * F.col("re")})
    for samples, base in ((own, "Y-Test"), (own, "zsketch"), (turned, "z_sketch")):
        A.write_samples(samples, base, folder)
    both = [A.read_samples(spark, base, folder).select(F.lit(base).alias("base"), "sample", "idx", "re", "im") for base in ("y_test", "z_sketch")]
    return rounded(reduce(DataFrame.unionByName, both))


@query(f"""WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), e AS (SELECT vec_id, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS re FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id AS sample, idx, {r("re", "re")} FROM e UNION ALL SELECT vec_id + n, idx, {r("re / 2", "re")} FROM e, n""")
def snk4_appended_samples(spark, sf_dir):
    """The measured vectors, and then their halves after them."""
    folder = Scratch(spark, "store").top
    own = measured(spark, sf_dir).select(F.col("vec").alias("sample"), F.col("idx").cast("long").alias("idx"), "re", "im")
    A.write_samples(own, "y_sketch", folder)
    A.append_samples(own.withColumn("re", F.col("re") / 2), "y_sketch", folder)
    return rounded(A.read_samples(spark, "y_sketch", folder).select("sample", "idx", "re"))


@query("""SELECT count(DISTINCT vec_id) AS n_samples, 64::BIGINT AS n_indices FROM embeddings WHERE embedding IS NOT NULL""")
def src7_sample_shape(spark, sf_dir):
    folder = Scratch(spark, "store").top
    own = measured(spark, sf_dir).select(F.col("vec").alias("sample"), F.col("idx").cast("long").alias("idx"), "re", "im")
    A.write_samples(own, "Y-Sketch", folder)
    n, m = A.sample_shape(spark, "ysketch", folder)
    return spark.range(1).select(F.lit(n).cast("long").alias("n_samples"), F.lit(m).cast("long").alias("n_indices"))


def written(spark, sf_dir):
    """A folder with a rank and a time document of each tolerance, and one of no kind that is read."""
    folder = Scratch(spark, "stats").top
    own = events(spark, sf_dir).groupBy("tolerance").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    listed = {c: F.array(F.col("n")) for c in ("ranks", "compression", "box_sizes", "near_field_sizes", "dec_boxes_per_level")}
    rank = own.select(F.lit("rank").alias("kind"), "tolerance", F.to_json(F.struct(F.col("s").alias("residual_size"), *(v.alias(c) for c, v in listed.items()))).alias("doc"))
    error = own.select(F.lit("error").alias("kind"), "tolerance", F.to_json(F.struct(F.col("n").alias("dim"), F.struct(F.array(F.array(F.col("n"))).alias("prec")).alias("solves"))).alias("doc"))
    D.write_stats(rank.unionByName(error).unionByName(error.withColumn("kind", F.lit("time"))), folder, "rank")
    return folder


@query(f"""WITH {DOCS} SELECT CAST(tolerance AS DOUBLE) AS tolerance, count(*) AS n, sum(event_id)::BIGINT AS residual_size FROM e GROUP BY 1""")
def src1_loaded_documents(spark, sf_dir):
    """Written as <kind>_stats_<tolerance>.json, then read by kind: rank documents."""
    t = D.typed(D.load_stats(spark, written(spark, sf_dir), "rank"), "rank")
    return t.select("tolerance", F.col("ranks")[0].alias("n"), "residual_size")


@query(f"""WITH {DOCS} SELECT kind, count(DISTINCT tolerance) AS n FROM e, (VALUES ('rank'), ('error')) AS k(kind) GROUP BY 1""")
def src20_fresh_files(spark, sf_dir):
    """Files written since just before, of each kind."""
    start = spark.sql("select current_timestamp() as t").first()["t"]
    found = D.fresh(spark, written(spark, sf_dir), start)
    kind = F.regexp_extract("file_path", r"([a-z]+)_stats_[^/]*$", 1)
    return found.where("file_modification_time is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOCS} SELECT CAST(tolerance AS DOUBLE) AS tolerance, count(*) AS dim, {r("count(*)", "solve")} FROM e GROUP BY 1""")
def snk1_written_documents(spark, sf_dir):
    t = D.typed(D.load_stats(spark, written(spark, sf_dir), "error"), "error")
    return rounded(t.select("tolerance", "dim", F.col("solves.prec")[0][0].alias("solve")))


@query("""SELECT CASE WHEN vec_id % 2 = 0 THEN 'sols_prec' ELSE 'sols_no_prec' END AS "group", count(*) * 64 AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1""")
def snk2_written_solutions(spark, sf_dir):
    folder = Scratch(spark, "solutions").top
    own = measured(spark, sf_dir).withColumns({"tolerance": F.lit(0.01), "group": F.when(F.col("vec") % 2 == 0, "sols_prec").otherwise("sols_no_prec")})
    D.write_solutions(own, folder)
    return spark.read.parquet(folder).groupBy("group").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT l_partkey AS id, l_suppkey AS i, l_quantity AS q FROM lineitem) SELECT id AS idx, {r("sum(q * sin(0.29 * (i + 1)) + q * 0.25 * cos(0.11 * (i + 1)))", "re", 6)} FROM x GROUP BY id""")
def udf2_operator_by_name(spark, sf_dir):
    op = make_operator("matrix", sparse(spark, sf_dir))
    x = P.test_vector(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).distinct())
    return rounded(checked(op.apply(x, "transpose")).select("idx", "re"), 6)
