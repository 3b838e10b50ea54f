"""Path pruning and path policy over tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filarium import constants as K
from filarium.functions import strings, trim_ws


def prune_paths(entries: DataFrame) -> DataFrame:
    """Drop entries below build, version-control and app-bundle folders."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    names = strings(K.SKIP_DIR_NAMES)

    def skipped(s: Column) -> Column:
        bundle = F.lit(False)
        for suffix in K.SKIP_BUNDLE_SUFFIXES:
            bundle = bundle | F.lower(s).endswith(suffix)
        return F.array_contains(names, s) | bundle

    return entries.filter(~F.exists(folders, skipped))


def normalise(path: Column) -> Column:
    """Trimmed path without doubled slashes and '.' segments."""
    p = F.regexp_replace(trim_ws(path), r"/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(?<=/)(?:\./)+", ""), r"(?<=/)\.$", "")


def path_problem(path: Column) -> Column:
    """Reason code for an unacceptable path, null for a clean one (P10)."""
    p = trim_ws(path)
    return (F.when(path.isNull() | (p == ""), "empty")
            .when(F.contains(p, F.lit("\0")), "null_byte")
            .when(F.array_contains(F.split(p, r"[/\\]"), ".."), "traversal")
            .when(~p.startswith("/"), "not_absolute")
            .when(F.length(normalise(path)) > K.MAX_PATH_CHARS, "too_long"))


def is_system_path(path: Column) -> Column:
    """Equal to or below one of the system folders, ignoring case."""
    low = F.lower(path)
    prefixes = strings([p.lower() for p in K.SYSTEM_PREFIXES])
    return F.exists(prefixes, lambda p: (low == p) | F.startswith(low, F.concat(p, F.lit("/"))))


def path_policy(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add ``normal_path`` and ``reason``; a null reason means accepted."""
    c = F.col(column)
    clean = normalise(c)
    return (paths.withColumn("reason", F.coalesce(
                path_problem(c), F.when(is_system_path(clean), "system_path")))
            .withColumn("normal_path", F.when(path_problem(c).isNull(), clean)))


def _ancestors(path: Column) -> Column:
    """The path itself and every folder above it."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def within_roots(paths: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path is one of the roots or below one.

    A path lies below a root exactly when the root is one of its ancestors, so
    this is an equality semi-join on exploded ancestors and needs no nested loop.
    The path itself is the row key: hot roots are met by many keys, not by one.
    """
    clean = roots.select(F.rtrim(normalise(F.col("path")), F.lit("/")).alias("_root")).distinct()
    hits = (paths.select(column, F.explode(_ancestors(normalise(F.col(column)))).alias("_root"))
            .join(clean, "_root", "left_semi").select(column).distinct())
    return paths.join(hits, column, "left_semi")


def by_status(df: DataFrame, status: str | None, default: str | None = None,
              column: str = "status") -> DataFrame:
    """Rows of one status; all rows when neither a status nor a default is given."""
    wanted = status or default
    return df.filter(F.col(column) == wanted) if wanted else df
