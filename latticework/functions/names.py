"""Names and number texts of result folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_to_snake(name: Column) -> Column:
    """SphereBigMesh to sphere_big_mesh."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def formatted(x: Column, kind: str) -> Column:
    """x as C formats it: the exact binary value is rounded, halves to even. Java's format_string rounds the shortest decimal, halves up."""

    def each(values):
        return values.map(lambda v: format(v, kind))

    own = x.cast("double")
    return F.when(own.isNull(), "null").when(F.isnan(own), "NaN").otherwise(F.pandas_udf(each, "string")(own))


def two_digits(x: Column) -> Column:
    """5.03e-3, 4.00e1: two decimals, exponent without sign or zeros in front unless negative."""
    return F.regexp_replace(F.regexp_replace(formatted(x, ".2e"), r"e\+0*(\d)", "e$1"), r"e-0*(\d)", "e-$1")


def shortest(x: Column) -> Column:
    """1e-2, 4e1, 2.5e0: as two_digits without zeros at the end of the mantissa."""
    return F.regexp_replace(F.regexp_replace(two_digits(x), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")


def folder(*parts: Column) -> Column:
    """Parts that are not null or empty, joined by underscores."""
    return F.concat_ws("_", F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")))


def _dimension(leveled: Column, first: Column, second: Column, plain: Column) -> Column:
    """By levels a mesh width below 1 or a level of refinement and a depth; else plain."""
    width, whole = F.concat(F.lit("mesh_width_"), two_digits(first)), lambda c: c.cast("long").cast("string")
    levels = F.concat(F.lit("ref_level_"), whole(first), F.lit("_depth_"), whole(second))
    return F.when(leveled, F.when(first < 1, width).otherwise(levels)).otherwise(plain)


def sample_key(geometry: Column, operator: Column, precision: Column, leveled: Column, first: Column, second: Column) -> Column:
    """Key of a run's samples, such as sphere_surface_name_precision_double_mesh_width_5.00e-2_kappa_1.50.

    leveled: first is a mesh width below 1, or a refinement level, and second a depth. Otherwise first is a mesh width and
    second kappa, which is left out if it is 0.
    """
    kappa = F.when(second != 0, F.concat(F.lit("_kappa_"), formatted(second, ".2f"))).otherwise("")
    plain = F.concat(F.lit("mesh_width_"), two_digits(first), kappa)
    return folder(camel_to_snake(geometry), operator, F.concat(F.lit("precision_"), F.lower(precision)), _dimension(leveled, first, second, plain))


def run_folder(geometry: Column, operator: Column, precision: Column, leveled: Column, first: Column, second: Column, tree_depth: Column, threads: Column, version: Column) -> Column:
    """Folder of a run's results: results/<key>/<version>; the key has the tree's depth (od) and, unless leveled, kappa always, and ends with the threads."""
    plain = F.concat(F.lit("mesh_width_"), two_digits(first))
    depth = F.concat(_dimension(leveled, first, second, plain), F.lit("_od_"), tree_depth.cast("string"))
    kappa = F.when(~leveled, formatted(second, ".2f"))
    key = folder(camel_to_snake(geometry), operator, F.concat(F.lit("precision_"), F.lower(precision)), depth, kappa, F.concat(F.lit("num_threads_"), threads.cast("string")))
    return F.concat_ws("/", F.lit("results"), key, version)
