"""Statistics documents of runs: reading, flattening and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.names import shortest
from latticework.session import ship
from latticework.sources.stats_files import StatsFiles

KINDS = ("error", "time", "rank", "condition_number", "block_error")
#: Fields of the documents, in the form of a schema.
FACTOR_MEMORY = "struct<total_bytes: long, id_bytes: long, lu_bytes: long, diag_bytes: long, perm_bytes: long, id_count: long, lu_count: long, diag_count: long>"
SNAPSHOT = f"struct<label: string, rss_bytes: long, peak_rss_bytes: long, baseline_rss_bytes: long, sample_buffer_bytes: long, factor_memory: {FACTOR_MEMORY}, accounted_factorization_bytes: long, estimated_temporary_runtime_bytes: long>"
SOLVES = "struct<no_prec: array<array<double>>, prec: array<array<double>>, rel_err_no_prec: array<double>, rel_err_prec: array<double>, vectors_file: string>"
TYPED = {
    "error": f"dim long, app_inv_err_left double, app_inv_err_right double, app_err_left double, app_err_right double, adjoint_consistency_error double, adjoint_consistency_error_inv double, self_adjoint_apply_error double, norm_apply_fro double, err_solve_fro double, norm_a_fro double, norm_apply_2 double, err_solve_2 double, norm_a_2 double, solve_error_rhs double, cond_rsrs_estimate double, tot_num_samples long, residual_size long, solves {SOLVES}",
    "time": "tot_num_samples long, min_samples long, max_level long, limiting_level long, leaf_count long, dim long, max_boxes long, max_points long, elapsed_time_at_limiting double, total_elapsed_time double, total_elapsed_time_wo_sampling double, untracked_rsrs_time double, sample_loading_time double, "
    "sampling_extraction_time double, extraction_time double, sampling_time array<double>, id_times array<struct<nullification: double, id: double>>, tot_id_time double, tot_lu_time double, lu_times array<struct<extraction: double, lu: double>>, update_times array<struct<id: double, lu: double>>, "
    "index_calculation double, sorting_near_field double, residual_calculation double, level_effort variant, mv_avg_time array<double>, matvec_benchmark_samples long, structured_operator_mv_avg_time_ns double, rsrs_operator_mv_avg_time_ns double, "
    f"run_start_rss_bytes long, max_sample_buffer_bytes long, max_factor_bytes long, max_accounted_factorization_bytes long, max_estimated_temporary_runtime_bytes long, memory_snapshots array<{SNAPSHOT}>",
    "rank": "residual_size long, ranks array<long>, compression array<double>, box_sizes array<long>, near_field_sizes array<long>, dec_boxes_per_level array<long>",
}
#: Fields without which a document is no document of its kind.
REQUIRED = {
    "error": ("dim",),
    "time": ("total_elapsed_time", "extraction_time", "sampling_time", "sampling_extraction_time", "id_times", "tot_id_time", "tot_lu_time", "lu_times", "update_times", "index_calculation", "sorting_near_field", "residual_calculation"),
    "rank": ("residual_size", "ranks", "compression", "box_sizes", "near_field_sizes", "dec_boxes_per_level"),
}
#: Numbers of a time document that are 0 where they are missing.
TIME_DEFAULTS = ("total_elapsed_time_wo_sampling", "untracked_rsrs_time", "sample_loading_time", "matvec_benchmark_samples", "structured_operator_mv_avg_time_ns", "rsrs_operator_mv_avg_time_ns", "max_sample_buffer_bytes", "max_factor_bytes", "max_accounted_factorization_bytes")
#: Kinds of documents that a mode writes.
MODES = {"all": KINDS, "rank": ("rank", "error"), "time": ("time",)}


def load_stats(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """tolerance and doc (JSON text) of every <kind>_stats_<tolerance>.json; names without a number are left out."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    text = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{kind}_stats_*.json")
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^{kind}_stats_(.*)\.json$", 1)
    return text.select(name.try_cast("double").alias("tolerance"), F.col("value").alias("doc")).where("tolerance is not null")


def typed(documents: DataFrame, kind: str) -> DataFrame:
    """documents (tolerance, doc and others) with the columns of a kind instead of doc.

    A missing or null field is null, or its default, or an error if the kind requires it; so is text that isn't JSON.
    """
    if kind not in TYPED:
        raise ValueError(f"no columns for kind {kind!r}; known: {sorted(TYPED)}")
    others = [c for c in documents.columns if c != "doc"]
    own = documents.select(*others, F.from_json("doc", TYPED[kind], {"mode": "FAILFAST"}).alias("d"))
    for name in REQUIRED[kind]:
        wrong = F.raise_error(F.lit(f"a document of kind {kind} has no {name}"))
        own = own.withColumn("d", F.when(F.col(f"d.{name}").isNull(), wrong.cast(own.schema["d"].dataType)).otherwise(F.col("d")))
    own = own.select(*others, "d.*")
    if kind == "time":
        own = own.withColumns({c: F.coalesce(c, F.lit(0)) for c in TIME_DEFAULTS} | {"memory_snapshots": F.coalesce("memory_snapshots", F.array().cast(own.schema["memory_snapshots"].dataType))})
    return own


def condition_rows(documents: DataFrame) -> DataFrame:
    """The other columns of documents, family (id, lu, dfactors), level, entry, part (rect, L, U), cond, norm of condition-number documents (doc).

    An entry is an array of elements [[cond, norm], null or [[condL, normL], [condU, normU]]]; null ones are dropped.
    """
    others = [c for c in documents.columns if c != "doc"]
    names, spark = ", ".join(f"`{c}`" for c in others), documents.sparkSession
    parsed = documents.select(*others, F.parse_json("doc").alias("v"))
    leveled = " union all ".join(
        f"select {names}, '{f}' as family, l.pos as level, e.pos as entry, e.value as x from {{docs}}, lateral variant_explode(try_variant_get(v, '$.{f}', 'variant')) as l, lateral variant_explode(l.value) as e" for f in ("id", "lu")
    )
    flat = f"select {names}, 'dfactors' as family, cast(null as int) as level, e.pos as entry, e.value as x from {{docs}}, lateral variant_explode(try_variant_get(v, '$.dfactors', 'variant')) as e"
    rows = spark.sql(f"select {names}, family, level, entry, k.pos as side, k.value as c from ({leveled} union all {flat}), lateral variant_explode(x) as k", docs=parsed)
    get = lambda path: F.try_variant_get("c", path, "double")
    parts = F.array(*(F.struct(F.lit(p).alias("part"), get(f"{path}[0]").alias("cond"), get(f"{path}[1]").alias("norm")) for p, path in (("rect", "$[0]"), ("L", "$[1][0]"), ("U", "$[1][1]"))))
    own = rows.select(*others, "family", "level", "entry", "side", F.explode(parts).alias("p"))
    return own.select(*others, "family", "level", "entry", "side", "p.part", "p.cond", "p.norm").where("cond is not null or norm is not null")


def block_error_rows(documents: DataFrame) -> DataFrame:
    """The other columns of documents, family (id, lu, diag), level, batch, k, value of block-error documents (doc)."""
    others = [c for c in documents.columns if c != "doc"]
    shape = "id_error_stats array<array<array<double>>>, lu_error_stats array<array<array<double>>>, diag_error_stats array<double>"
    d = documents.select(*others, F.from_json("doc", shape).alias("d"))
    out = None
    for f in ("id", "lu"):
        one = d.select(*others, F.posexplode(f"d.{f}_error_stats").alias("level", "x")).select(*others, "level", F.posexplode("x").alias("batch", "y"))
        one = one.select(*others, F.lit(f).alias("family"), "level", "batch", F.posexplode("y").alias("k", "value"))
        out = one if out is None else out.unionByName(one)
    diag = d.select(*others, F.lit("diag").alias("family"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("batch"), F.posexplode("d.diag_error_stats").alias("k", "value"))
    return out.unionByName(diag)


def decode_vector(values: DataFrame) -> DataFrame:
    """idx, re, im from a column `values` of JSON arrays: numbers are a real vector, pairs a complex one; null has no entries, all else is an error."""
    both = values.select("values", F.from_json("values", "array<double>").alias("r"), F.from_json("values", "array<array<double>>").alias("c"))
    kind = "array<struct<idx: int, re: double, im: double>>"
    real = F.transform("r", lambda x, i: F.struct(i.alias("idx"), x.alias("re"), F.lit(0.0).alias("im"))).cast(kind)
    pairs = F.transform("c", lambda x, i: F.struct(i.alias("idx"), x[0].alias("re"), x[1].alias("im"))).cast(kind)
    wrong = F.raise_error(F.concat(F.lit("neither a vector nor pairs: "), F.left("values", F.lit(40)))).cast(kind)
    is_real = F.col("values").rlike(r"^\s*\[") & F.col("r").isNotNull() & F.forall("r", lambda x: x.isNotNull())
    is_pairs = F.col("c").isNotNull() & F.forall("c", lambda x: x.isNotNull() & (F.size(x) == 2) & x[0].isNotNull() & x[1].isNotNull())
    entries = F.when(F.col("values").isNull(), F.array().cast(kind)).when(F.coalesce(is_real, F.lit(False)), real).when(F.coalesce(is_pairs, F.lit(False)), pairs).otherwise(wrong)
    return both.select(F.explode(entries).alias("e")).select("e.*")


def solution_group(solutions: DataFrame, tolerance: float, group: str | None = None) -> DataFrame:
    """vec, idx, re, im of the solutions of a tolerance; 0 means the unpreconditioned ones of the smallest tolerance."""
    if tolerance == 0:
        least = solutions.agg(F.min("tolerance").alias("tolerance"))
        return solutions.join(F.broadcast(least), "tolerance").where("group = 'sols_no_prec'").select("vec", "idx", "re", "im")
    return solutions.where((F.abs(F.col("tolerance") - tolerance) <= 1e-8 + 1e-5 * abs(tolerance)) & (F.col("group") == (group or "sols_prec"))).select("vec", "idx", "re", "im")


def write_stats(documents: DataFrame, folder: str, mode: str = "all") -> int:
    """Writes each of documents (kind, tolerance, doc) to folder/<kind>_stats_<tolerance>.json, as load_stats reads it, in place of an older one.

    mode all, rank or time picks kinds. Tolerances have three digits at most in the name (1e-2, 4e1); two documents of
    a name are an error, before anything is written. Tasks write the files, by the data source of stats_files.py: an old
    one stays until the new one takes its name. Returns how many.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(MODES)}")
    spark = documents.sparkSession
    ship(spark)
    own = documents.where(F.col("kind").isin(*MODES[mode])).select("kind", F.concat("kind", F.lit("_stats_"), shortest(F.col("tolerance"))).alias("name"), "doc")
    counts = own.groupBy("name").agg(F.count("*").alias("n"))
    twice = counts.where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['n']} documents named {twice['name']}")
    StatsFiles.register(spark)
    own.write.format("stats_files").mode("append").save(folder)
    return counts.count()


def write_solutions(solutions: DataFrame, folder: str) -> None:
    """Writes tolerance, group, vec, idx, re, im; vectors of a group must be of one length."""
    uneven = solutions.groupBy("tolerance", "group", "vec").agg(F.count("*").alias("n")).groupBy("tolerance", "group").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a <> b")
    if not uneven.isEmpty():
        raise ValueError("solution vectors of different lengths")
    solutions.write.partitionBy("tolerance", "group").mode("overwrite").parquet(folder)


def fresh(spark: SparkSession, path: str, start, slack: str = "1 second") -> DataFrame:
    """The files at a path that were written since start, less a second; none there, or an older one, is an error."""
    own = spark.read.text(path, wholetext=True).select("_metadata.file_path", "_metadata.file_modification_time")
    stale = F.raise_error(F.concat(F.lit("stale result "), F.col("file_path")))
    return own.withColumn("file_modification_time", F.when(F.col("file_modification_time") >= F.lit(start) - F.expr(f"interval {slack}"), F.col("file_modification_time")).otherwise(stale.cast("timestamp")))
