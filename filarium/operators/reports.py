"""Totals and breakdowns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from filarium import constants as K
from filarium.functions import date_text, lookup


def _zero(c) -> Column:
    return F.coalesce(c, F.lit(0))


def _percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10).otherwise(F.lit(0.0))


def one_row(*parts: DataFrame) -> DataFrame:
    """Put single-row totals side by side, as scalar subqueries of the first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumn("_p", p.select(F.struct("*")).scalar()).select("*", "_p.*").drop("_p")
    return out


def file_counts(files: DataFrame) -> DataFrame:
    """Total, ready, corrupted and the share that is ready (A1)."""
    total, ready = F.count("*"), F.count_if(F.col("status") == "ready")
    return files.agg(total.alias("total_files"), ready.alias("ready"),
                     F.count_if(F.col("status") == "corrupted").alias("corrupted_count"),
                     _percent(ready, total).alias("organised_percent"))


def recoverable(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """Pending groups, bytes saved by resolved ones, bytes of other findings (A2)."""
    g = groups.agg(F.count_if(F.col("status") == "pending").alias("duplicates_count"),
                   _zero(F.sum(F.when(F.col("status") == "resolved", F.col("saved_bytes")))).alias("space_saved_bytes"))
    f = findings.agg(_zero(F.sum(F.when(F.col("finding_status") != "duplicate", F.col("size_bytes")))).alias("bytes_recoverable"))
    return one_row(g, f)


def system_status(scans: DataFrame, files: DataFrame) -> DataFrame:
    """Status word, active scan and last finished scan (A3)."""
    running = F.col("status") == "running"
    ended = F.col("status").isin("completed", "cancelled", "failed")
    first = F.min(F.when(running, F.struct("scan_id", "path", "progress_percent")))
    s = scans.agg(F.max(F.when(ended, F.col("completed_at"))).alias("last_scan_at"), first.alias("_a"))
    n = files.agg(F.count("*").alias("_n"))
    return one_row(s, n).select(
        F.when(F.col("_a").isNotNull(), "scanning").when(F.col("_n") > 0, "ready").otherwise("idle").alias("system_status"),
        F.col("_a").isNotNull().cast("int").alias("in_progress_scans"), "last_scan_at",
        F.col("_a.path").alias("current_scan_path"), F.col("_a.progress_percent").alias("current_scan_progress"))


def dashboard_summary(files: DataFrame, groups: DataFrame, findings: DataFrame, scans: DataFrame) -> DataFrame:
    """The dashboard's one-row summary (A1-A3)."""
    return one_row(file_counts(files), recoverable(groups, findings), system_status(scans, files))


def share_of(df: DataFrame, column: str, of: str = "total") -> DataFrame:
    """Share of the total or of the largest value.

    The one number is an aggregate that combines before the shuffle and goes to every task, so no
    task gets all rows.
    """
    agg = F.sum(column) if of == "total" else F.max(column)
    return df.withColumn("share", F.col(column) / df.agg(agg.alias("whole")).scalar())


def label_category(df: DataFrame, icons: bool = True) -> DataFrame:
    """Label and icon of a category; unknown ones show their own name."""
    label = lookup(F.col("category"), {c: text for c, text, _ in K.CATEGORY_LABELS}, F.col("category"))
    icon = lookup(F.col("category"), {c: i for c, _, i in K.CATEGORY_LABELS}, F.lit(K.CATEGORY_ICON_DEFAULT))
    own = F.col("category")
    return df.withColumn("label", label).withColumn("icon", icon if icons else own)


def category_breakdown(files: DataFrame) -> DataFrame:
    """Files per category with percent of total (A4). Categories are few, so the
    window runs over a handful of grouped rows."""
    per = files.groupBy("category").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return label_category(per.withColumn("percent_of_total", _percent(F.col("count"), total)))


def untagged(files: DataFrame) -> DataFrame:
    """Files without tags."""
    return files.filter(F.coalesce(F.size("tags"), F.lit(0)) <= 0)


def needs_attention(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Corrupted files, pending groups, untagged files (A5)."""
    f = files.agg(F.count_if(F.col("status") == "corrupted").alias("corrupted_files"),
                  F.count_if(F.coalesce(F.size("tags"), F.lit(0)) <= 0).alias("untagged_files"))
    return one_row(f, groups.agg(F.count_if(F.col("status") == "pending").alias("duplicates")))


def file_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and one count per status."""
    return files.agg(F.count("*").alias("total"), _zero(F.sum("size_bytes")).alias("total_size_bytes"),
                     *[F.count_if(F.col("status") == s).alias(s) for s in K.ENUMS["file_status"]])


def report_overview(files: DataFrame, scans: DataFrame, groups: DataFrame) -> DataFrame:
    """Files, bytes, scans, groups resolved and bytes saved."""
    return one_row(
        files.agg(F.count("*").alias("total_files_indexed"), _zero(F.sum("size_bytes")).alias("total_size_bytes")),
        scans.agg(F.count("*").alias("total_scans")),
        groups.agg(F.count_if(F.col("status") == "resolved").alias("duplicates_resolved"),
                   _zero(F.sum("saved_bytes")).alias("space_saved_bytes")))


def file_type_breakdown(files: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent extensions with their bytes."""
    return (files.groupBy("extension").agg(F.count("*").alias("count"), _zero(F.sum("size_bytes")).alias("size_bytes"))
            .orderBy(F.desc("count"), "extension").limit(k))


def scan_history(scans: DataFrame, now: datetime | None = None, days: int = 30, last: int | None = None) -> DataFrame:
    """Scans of the last ``days`` days before ``now``, or the ``last`` n scans."""
    shown = scans
    if now is not None:
        shown = shown.filter(F.col("started_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if last is not None:
        shown = shown.orderBy(F.desc("started_at"), "scan_id").limit(last)
    return shown.select("scan_id", date_text(F.col("started_at")).alias("date"), "files_scanned", "duplicates_found")


def findings_by_type(findings: DataFrame) -> DataFrame:
    """Counts by (type, status), by type, by status and overall in one pass (A10)."""
    return (findings.groupingSets([["type", "finding_status"], ["type"], ["finding_status"], []], "type", "finding_status")
            .agg(F.count("*").alias("count"), F.grouping_id().alias("level")))


def findings_summary(findings: DataFrame, scan_id: int | None = None) -> DataFrame:
    """One row: total, the three status totals and a map by type (A10)."""
    if scan_id is not None:
        findings = findings.filter(F.col("scan_id") == scan_id)
    per = findings.groupBy("type", "finding_status").agg(F.count("*").alias("n"))
    status = F.col("finding_status")
    totals = per.agg(_zero(F.sum("n")).alias("total"),
                     *[_zero(F.sum(F.when(status == s, F.col("n")))).alias(s) for s in ("safe_delete", "review", "duplicate")])
    by_type = per.groupBy("type").agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    return one_row(totals, by_type)


def scan_roots(scans: DataFrame) -> DataFrame:
    """Scans and last scan per root path."""
    return scans.groupBy("path").agg(F.count("*").alias("scan_count"), F.max("started_at").alias("last_scanned_at"))


def duration_text(started: Column, completed: Column) -> Column:
    """Elapsed time as '42s' or '3m 5s'; a dash when unknown or negative."""
    ms = F.unix_millis(completed) - F.unix_millis(started)
    s = F.floor(ms / 1000 + 0.5).cast("bigint")
    return (F.when(ms.isNull() | (ms < 0), "—").when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))))


def scan_durations(scans: DataFrame) -> DataFrame:
    """Duration and files per second of each scan."""
    seconds = (F.unix_millis("completed_at") - F.unix_millis("started_at")) / 1000
    return scans.select("scan_id", duration_text(F.col("started_at"), F.col("completed_at")).alias("duration"),
                        F.when(seconds > 0, F.round(F.col("files_scanned") / seconds, 3)).alias("files_per_second"))
