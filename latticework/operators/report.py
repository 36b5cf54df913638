"""Summaries, rankings, comparisons and gates of run results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.results import close_to, valid
from latticework.operators.quantiles import MOST, quantiles


def mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric by keys."""
    return df.groupBy(*keys).agg(*(f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def all_but_last(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, mean_rest (null for a single row) and last, in the order of columns that make it total."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(F.sum(value).alias("s"), F.count("*").alias("n"), F.max_by(value, place).alias("last")).select(*keys, F.try_divide(F.col("s") - F.col("last"), F.col("n") - 1).alias("mean_rest"), "last")


def phase_totals(times: DataFrame, key: str, phases: list[str], totals: DataFrame) -> DataFrame:
    """key, total, the sum of each phase, and `other`: what of total they leave, 0 at least.

    times: key, phase, value, a row for each time; totals: key, total. Phases without times sum to 0.
    """
    sums = times.groupBy(key).agg(*(F.sum(F.when(F.col("phase") == n, F.col("value"))).alias(n) for n in phases))
    own = totals.join(sums, key, "left").select(key, "total", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in phases))
    return own.withColumn("other", F.greatest(F.col("total") - reduce(Column.__add__, (F.col(n) for n in phases)), F.lit(0.0)))


def shares(df: DataFrame, key: str, phases: list[str], drop_zero: bool = False) -> DataFrame:
    """key, phase, value, share of the phases' sum; zero phases left out on request."""
    long = df.unpivot([key], phases, "phase", "value")
    long = long.where("value > 0") if drop_zero else long
    return long.withColumn("share", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy(key))))


def level_summary(df: DataFrame, keys: list[str], value: str, most: int = MOST) -> DataFrame:
    """mean, median, std of the valid numbers by keys; keys without any are left out."""
    own = df.where(valid(F.col(value)))
    middle, group = quantiles(own, keys, value, [0.5], most), F.struct(*keys)  # structs compare nulls as equal
    sums = own.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn("_g", group)
    return sums.join(middle.select(group.alias("_g"), F.col("q")[0].alias("median")), "_g").select(*keys, "mean", "median", "std")


def box_plot(df: DataFrame, keys: list[str], value: str, most: int = MOST) -> DataFrame:
    """q1, median, q3, whiskers (furthest values within 1.5 times the quartile range) and n_outliers by keys; null keys are a group."""
    own = df.where(valid(F.col(value)))
    q = quantiles(own, keys, value, [0.25, 0.5, 0.75], most).select(F.struct(*keys).alias("_g"), *(F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))))
    fences = q.withColumns({"low": F.expr("q1 - 1.5 * (q3 - q1)"), "high": F.expr("q3 + 1.5 * (q3 - q1)")})
    inside = F.col(value).between(F.col("low"), F.col("high"))
    both = own.select(F.struct(*keys).alias("_g"), value).join(fences, "_g")
    sums = both.groupBy("_g", "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.sum((~inside).cast("int")).cast("long").alias("n_outliers"))
    return sums.select(*(F.col("_g")[c].alias(c) for c in keys), "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """case, n_failed, failed (metric names in order, comma-joined), verdict.

    metrics: case, metric, value. thresholds: case, metric, max_value, expected. A value fails if it is null or NaN,
    reaches max_value, or differs from expected; null limits are skipped, and a metric with limits but no row fails.
    """
    own = thresholds.join(metrics, ["case", "metric"], "left")
    missing = F.col("value").isNull() | F.isnan("value")
    bad = (F.col("max_value").isNotNull() & (missing | (F.col("value") >= F.col("max_value")))) | (F.col("expected").isNotNull() & (missing | (F.col("value") != F.col("expected"))))
    failed = F.array_sort(F.array_compact(F.collect_list(F.when(bad, F.col("metric")))))
    return own.groupBy("case").agg(failed.alias("f")).select("case", F.size("f").alias("n_failed"), F.array_join("f", ",").alias("failed"), F.when(F.size("f") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def cross_rules(wide: DataFrame, most_relative: float | None = None) -> DataFrame:
    """case, failed (names of the rules that don't hold, comma-joined) of rows with the norms and errors of a case.

    norms_present: norm_apply_2, norm_apply_fro, norm_a_2, norm_a_fro. Only with these: norm_2_below_norm_fro
    (norm_apply_2 < norm_apply_fro), norm_a_2_positive, and, if it is, relative_norm_2 (norm_apply_2 / norm_a_2 <
    most_relative, if given). solve_errors_present: err_solve_2, err_solve_fro.
    """
    there = lambda *names: reduce(Column.__and__, (F.col(n).isNotNull() for n in names))
    norms = there("norm_apply_2", "norm_apply_fro", "norm_a_2", "norm_a_fro")
    positive = F.col("norm_a_2") > 0
    broken = [("norms_present", ~norms), ("norm_2_below_norm_fro", norms & ~(F.col("norm_apply_2") < F.col("norm_apply_fro"))), ("norm_a_2_positive", norms & ~positive)]
    if most_relative is not None:
        broken.append(("relative_norm_2", norms & positive & (F.col("norm_apply_2") >= most_relative * F.col("norm_a_2"))))
    broken.append(("solve_errors_present", ~there("err_solve_2", "err_solve_fro")))
    return wide.select("case", F.array_join(F.array_compact(F.array(*(F.when(wrong, F.lit(n)) for n, wrong in broken))), ",").alias("failed"))


#: Errors of a run that its iteration summary lists.
SELECTED = ("solve_error_rhs", "app_condition_number", "norm_apply_2", "err_solve_2")


def iteration_summary(residuals: DataFrame, errors: DataFrame) -> DataFrame:
    """tolerance, mean_no_prec, mean_prec (mean numbers of residuals a right-hand side, null without any), n_no_prec,
    n_prec (right-hand sides that have any) and SELECTED of each row of errors; columns that errors lacks are null.

    residuals: tolerance, curve (no_prec or prec), rhs, a row for each residual.
    """
    lengths = residuals.groupBy("tolerance", "curve", "rhs").agg(F.count("*").alias("n"))
    of = lambda c: F.when(F.col("curve") == c, F.col("n"))
    means = lengths.groupBy("tolerance").agg(*(F.avg(of(c)).alias(f"mean_{c}") for c in ("no_prec", "prec")), *(F.count(of(c)).alias(f"n_{c}") for c in ("no_prec", "prec")))
    listed = [F.col(c) if c in errors.columns else F.lit(None).cast("double").alias(c) for c in SELECTED]
    return errors.select("tolerance", *listed).join(means, "tolerance", "left").select("tolerance", "mean_no_prec", "mean_prec", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_no_prec", "n_prec")), *SELECTED)


#: The error metrics by number, from 1.
SERIES = ("norm_apply_2", "err_solve_2", "cond_rsrs_estimate", "tot_num_samples", "residual_size")


def _series(stats: DataFrame, column: str, factor: float = 1.0) -> DataFrame:
    value = F.col(column).cast("double") * factor if column in stats.columns else F.lit(float("nan"))
    return stats.select("tolerance", value.alias("value")).orderBy(F.col("tolerance").asc_nulls_last())


def metric_series(stats: DataFrame, metric: int) -> DataFrame:
    """tolerance, value of the metric of that number in SERIES, smallest tolerance first; NaN where stats has no such column."""
    if not 1 <= metric <= len(SERIES):
        raise ValueError(f"metrics are numbered 1 to {len(SERIES)}")
    return _series(stats, SERIES[metric - 1])


def elapsed_seconds(times: DataFrame) -> DataFrame:
    """tolerance, value: total_elapsed_time_wo_sampling (milliseconds) in seconds, smallest tolerance first."""
    return _series(times, "total_elapsed_time_wo_sampling", 1 / 1000)


def iteration_series(residuals: DataFrame) -> DataFrame:
    """method, tolerance, n of residuals (tolerance, method, a row for each residual), without the method no_prec; smallest tolerance first."""
    own = residuals.where(F.col("method") != "no_prec").groupBy("method", "tolerance").agg(F.count("*").alias("n"))
    return own.orderBy("method", F.col("tolerance").asc_nulls_last())


def degrees_of_freedom(times: DataFrame) -> DataFrame:
    """dim of the document of the smallest tolerance; no row without documents."""
    return times.orderBy(F.col("tolerance").asc_nulls_last()).limit(1).select("dim")


def at_tolerance(stats: DataFrame, tolerance: float | None) -> DataFrame:
    """The row of the first tolerance close to the one asked for, or of the smallest; none is an error."""
    own = stats if tolerance is None else stats.where(close_to(F.col("tolerance"), tolerance))
    own = own.orderBy("tolerance").limit(1)
    if own.isEmpty():
        raise ValueError(f"no results for tolerance {tolerance}")
    return own


def extent(points: DataFrame) -> DataFrame:
    """Bounds, mean, radius (largest distance from the mean) and diagonal of points."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    square = sum(((F.col(c) - F.col(f"mean_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    radius = points.crossJoin(F.broadcast(box)).agg(F.sqrt(F.max(square)).alias("radius"))
    diagonal = F.sqrt(sum(((F.col(f"max_{c}") - F.col(f"min_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return box.crossJoin(radius).withColumn("diagonal", diagonal)


def _finite(value: str) -> Column:
    return valid(F.col(value)) & (F.abs(value) < float("inf"))


def contrast_range(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, most: int = MOST) -> DataFrame:
    """low and high: two quantiles of the finite values, or 0 and 1 without any; an empty range gets length 1."""
    q = df.sparkSession.range(1).join(quantiles(df.where(_finite(value)), [], value, [low, high], most), how="left")
    q = q.select(F.coalesce(F.col("q")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("q")[1], F.lit(1.0)).alias("high"))
    return q.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1).otherwise(F.col("high")))


def contrast(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, how: str = "linear", power: float = 0.5, limits: DataFrame | None = None) -> DataFrame:
    """df with scaled: the value between two quantiles, cut and brought to 0..1, then linear, power or log.

    limits is a row of contrast_range, if it is there already. Values that aren't finite count for no quantile and
    scale to null; log starts at 1e-12 of the top.
    """
    limits = contrast_range(df, value, low, high) if limits is None else limits
    own = df.crossJoin(F.broadcast(limits.select(F.col("low").alias("_low"), F.col("high").alias("_high"))))  # one row
    cut = F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))
    if how == "log":
        floor = F.greatest(1e-12 * F.col("_high"), F.lit(1e-300))
        base = F.greatest(F.col("_low"), floor)
        scaled = F.try_divide(F.ln(F.greatest(cut, base) / base), F.ln(F.col("_high") / base))
    else:
        scaled = (cut - F.col("_low")) / (F.col("_high") - F.col("_low"))
        scaled = F.pow(scaled, F.lit(power)) if how == "power" else scaled
    return own.withColumn("scaled", F.when(_finite(value), scaled)).drop("_low", "_high")


def shared_range(df: DataFrame, value: str) -> DataFrame:
    """low and high of the finite values; 0 and 1 without any."""
    return df.where(_finite(value)).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("low"), F.coalesce(F.max(value), F.lit(1.0)).alias("high"))


#: Byte counts and counts of a snapshot's factor_memory.
FACTOR_BYTES = ("total_bytes", "id_bytes", "lu_bytes", "diag_bytes", "perm_bytes")
FACTOR_COUNTS = ("id_count", "lu_count", "diag_count")


def memory_report(snapshots: DataFrame, key: str) -> DataFrame:
    """Number and largest values of each run's memory snapshots: key and a row (label, rss_bytes, peak_rss_bytes, factor_memory) for each.

    max_rss, max_peak, max_id_lu (id and lu bytes of one snapshot together), and max_ of all byte counts and counts of factor_memory.
    """
    parts = [F.max(F.col(f"factor_memory.{c}")).alias(f"max_{c}") for c in (*FACTOR_BYTES, *FACTOR_COUNTS)]
    both = F.max(F.col("factor_memory.id_bytes") + F.col("factor_memory.lu_bytes")).alias("max_id_lu")
    return snapshots.groupBy(key).agg(F.count("*").alias("n_snapshots"), F.max("rss_bytes").alias("max_rss"), F.max("peak_rss_bytes").alias("max_peak"), both, *parts)


def worst_route(df: DataFrame) -> DataFrame:
    """factor, mode, defect: each factor's largest defect and the first mode in order that has it; '' if all are 0."""
    own = df.where(valid(F.col("defect")))
    return own.groupBy("factor").agg(F.max_by("mode", F.struct("defect", -F.col("mode_order"))).alias("mode"), F.max("defect").alias("defect")).select("factor", F.when(F.col("defect") > 0, F.col("mode")).otherwise("").alias("mode"), "defect")


def norm_ratio(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio of the Frobenius norms of entries by keys; null if the first is 0."""
    norm = lambda df, n: df.groupBy(*keys).agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias(n))
    return norm(before, "b").join(norm(after, "a"), keys, "left").select(*keys, F.try_divide(F.coalesce("a", F.lit(0.0)), F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))


def comparison(df: DataFrame, row: str, column: str, value: str, columns: list[str], pattern: str = "%.2f") -> DataFrame:
    """A row for each `row`, a text for each column, -- where there is no value."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide.select(row, *(F.when(F.col(f"`{c}`").isNull(), "--").otherwise(F.format_string(pattern, F.col(f"`{c}`"))).alias(c) for c in columns))


def improved(old: DataFrame, new: DataFrame, keys: list[str], value: str, factor: float = 2.0) -> DataFrame:
    """keys, old, new, improved: the old value is `factor` times the new one at least."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full")
    return both.withColumn("improved", F.coalesce(F.col("old") >= factor * F.col("new"), F.lit(False)))


def sorted_index(df: DataFrame, keys: list[str], value: str, tie: str, ranges: int = 64) -> DataFrame:
    """df with place (long, from 0) of the value within keys, nulls first.

    Values are cut into about `ranges` ranges at approximate quantiles over all rows; a place is the number of rows
    of the keys in lower ranges and the rank within the range, so no task has to sort all rows of a key.
    """
    cuts = df.agg(F.percentile_approx(value, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(4 * ranges)).alias("_cuts"))
    own = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))).drop("_cuts")
    counts = own.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_range", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value, tie)) - 1
    placed = own.withColumn("_rank", rank).join(before, [*keys, "_range"])
    return placed.withColumn("place", F.col("_before") + F.col("_rank")).select(*df.columns, "place")


def energy_ranks(x: DataFrame, key: str = "vec") -> DataFrame:
    """key, idx, energy (share of the sum, which is 1e-30 at least), rank (from 1, ties by idx)."""
    square = F.col("re") ** 2 + F.col("im") ** 2
    total = F.greatest(F.sum(square).over(Window.partitionBy(key)), F.lit(1e-30))
    return x.select(key, "idx", (square / total).alias("energy")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("energy"), "idx")))


def top_energy(x: DataFrame, tops: tuple[int, ...] = (10, 25), key: str = "vec") -> DataFrame:
    """key and the energy of its first ranks, a column for each of tops."""
    return energy_ranks(x, key).groupBy(key).agg(*(F.sum(F.when(F.col("rank") <= k, F.col("energy"))).alias(f"top_{k}") for k in tops))


def residual_curves(residuals: DataFrame) -> DataFrame:
    """tolerance, curve (prec or no_prec), step, residual of the first right-hand side, from rows that have rhs besides.

    Tolerances without a preconditioned history are left out; the other curve comes once, from the smallest tolerance.
    """
    firsts = residuals.groupBy("tolerance", "curve").agg(F.min("rhs").alias("rhs"))
    plain = firsts.where("curve = 'no_prec'").orderBy("tolerance").limit(1)
    wanted = firsts.where("curve = 'prec'").unionByName(plain)
    return residuals.join(wanted, ["tolerance", "curve", "rhs"], "left_semi").select("tolerance", "curve", "step", "residual")


def by_tolerance(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("tolerance").asc_nulls_last())


def slice_order(files: DataFrame, name: str = "name") -> DataFrame:
    """files with kind (0 numbered, 1 _sum, 2 rest) and number, in that order."""
    number = F.regexp_extract(name, r"_(\d+)(?:\.\w+)?$", 1)
    own = files.withColumns({"kind": F.when(number != "", 0).when(F.col(name).rlike(r"_sum(\.\w+)?$"), 1).otherwise(2), "number": F.coalesce(number.try_cast("int"), F.lit(-1))})
    return own.orderBy("kind", "number", name)


def transpose_checks(pairs: DataFrame) -> DataFrame:
    """symmetry_defect and imaginary_share of a matrix (i, j, re, im), relative Frobenius with a floor of 1e-14."""
    a, b = pairs.alias("a"), pairs.alias("b")
    both = a.join(b, (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i")), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gap = (zero("a.re") - zero("b.re")) ** 2 + (zero("a.im") - zero("b.im")) ** 2
    size = pairs.agg(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("n"), F.sqrt(F.sum(F.col("im") ** 2)).alias("m"))
    return both.agg(F.sqrt(F.sum(gap)).alias("g")).crossJoin(size).select((F.col("g") / F.greatest("n", F.lit(1e-14))).alias("symmetry_defect"), (F.col("m") / F.greatest("n", F.lit(1e-14))).alias("imaginary_share"))


