"""Review workflow: state tables folded from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filarium import constants as K
from filarium.functions import lookup
from filarium.operators.skew import join_hot, latest

# Width of a time slice in the audit log; a busy finding is spread over its slices.
SLICE_SECONDS = 3600


def review_status(action: Column) -> Column:
    """Review status an action leads to."""
    return lookup(action, K.REVIEW_ACTIONS, F.lit("reviewed"))


def fold_reviews(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with the status of their latest review event (R2).

    ``events``: event_id, finding_id, action, ts.
    """
    last = latest(events.select("finding_id", "action", "ts", "event_id"), ["finding_id"], ["ts", "event_id"])
    new = last.select("finding_id", review_status(F.col("action")).alias("_s"), F.col("ts").alias("reviewed_at"))
    base = findings.drop("reviewed_at")
    if "review_status" not in base.columns:
        base = base.withColumn("review_status", F.lit("new"))
    return (base.join(new, "finding_id", "left")
            .withColumn("review_status", F.coalesce("_s", "review_status")).drop("_s"))


def review_audit(events: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Events with the status before and after each.

    The status before is that of the preceding event of the finding. It is found
    within a time slice, and for the first event of a slice from the last event of
    the finding's slice before it, so one busy finding is not sorted in one task.
    """
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slice_seconds)
    e = events.withColumn("new_status", review_status(F.col("action"))).withColumn("_slot", slot)
    within = Window.partitionBy("finding_id", "_slot").orderBy("ts", "event_id")
    ends = e.groupBy("finding_id", "_slot").agg(F.max_by("new_status", F.struct("ts", "event_id")).alias("_last"))
    carry = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy("finding_id").orderBy("_slot"))).drop("_last")
    return (e.withColumn("_prev", F.lag("new_status").over(within))
            .join(carry, ["finding_id", "_slot"])
            .withColumn("previous_status", F.coalesce("_prev", "_carry", F.lit("new")))
            .drop("_prev", "_carry", "_slot"))


def proposed_actions(findings: DataFrame, events: DataFrame, dismissals: DataFrame | None = None) -> DataFrame:
    """One proposed action per accepted recommendation."""
    accepted = events.filter("action = 'accept_recommendation'").select("event_id", "finding_id", "ts")
    counts = accepted.groupBy("finding_id").agg(F.count("*").alias("_n"))
    advice = findings.filter("suggested_action <> ''").select("finding_id", "suggested_action", "suggested_destination")
    queue = (join_hot(accepted, advice, ["finding_id"], "_n", ["event_id"], weights=counts)
             .select(F.col("event_id").alias("action_id"), "finding_id", F.col("ts").alias("created_at"),
                     F.when(F.coalesce("suggested_destination", F.lit("")) != "", "move").otherwise("archive").alias("action_type"),
                     F.nullif("suggested_destination", F.lit("")).alias("proposed_destination"),
                     F.col("suggested_action").alias("description"), F.lit("pending").alias("status")))
    if dismissals is None:
        return queue
    gone = dismissals.select("action_id", F.lit("dismissed").alias("_d")).distinct()
    return queue.join(gone, "action_id", "left").withColumn("status", F.coalesce("_d", "status")).drop("_d")


def fold_ignores(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings after ignore and unignore events.

    ``events``: event_id, finding_id, action ('ignore' or 'unignore'), ts. Taking
    an ignore back gives 'duplicate' for duplicates and 'review' for the rest.
    """
    moves = events.filter(F.col("action").isin("ignore", "unignore")).select("finding_id", "action", "ts", "event_id")
    last = latest(moves, ["finding_id"], ["ts", "event_id"]).select("finding_id", F.col("action").alias("_a"))
    restored = F.when(F.col("type") == "duplicate", "duplicate").otherwise("review")
    return (findings.join(last, "finding_id", "left")
            .withColumn("finding_status", F.when(F.col("_a") == "ignore", "ignored")
                        .when(F.col("_a") == "unignore", restored).otherwise(F.col("finding_status")))
            .drop("_a"))


def clear_findings(findings: DataFrame, scan_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings left, number cleared)."""
    gone = F.lit(True) if scan_id is None else F.coalesce(F.col("scan_id") == scan_id, F.lit(False))
    return findings.filter(~gone), findings.agg(F.count_if(gone).alias("cleared"))


def fail_interrupted(scans: DataFrame) -> DataFrame:
    """Scans found running after a restart have failed."""
    return scans.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def scan_activity(totals: DataFrame) -> DataFrame:
    """Activity events of finished scans (R8); a scan with ``error_message`` yields an error.

    ``totals``: scan_id, files_scanned, findings_count, duplicates_found, duplicate_files.
    """
    def event(kind, status, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("message"), F.lit(status).alias("status"))

    files = F.format_number("files_scanned", 0)
    n = F.col("duplicates_found")
    done = F.array(
        event("classification_complete", "success", F.format_string("Classification complete — %s files scanned", files)),
        F.when(n > 0, event("duplicate_found", "warning", F.format_string(
            "%d duplicate group%s detected (%d files)", n, F.when(n > 1, "s").otherwise(""), F.col("duplicate_files")))),
        event("scan_complete", "success", F.format_string("Scan complete — %s files, %d findings", files, F.col("findings_count"))))
    if "error_message" in totals.columns:
        failed = F.array(event("error", "error", F.concat(F.lit("Scan failed: "), F.col("error_message"))))
        done = F.when(F.col("error_message").isNotNull(), failed).otherwise(done)
    return (totals.select("scan_id", F.explode(F.filter(done, lambda x: x.isNotNull())).alias("e"))
            .select("scan_id", "e.type", "e.message", "e.status"))


def drop_orphans(child: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None,
                 set_null: bool = False) -> DataFrame:
    """Delete rows whose parent is gone, or clear their reference."""
    ids = parents.select(F.col(parent_key or key).alias(key)).distinct()
    if not set_null:
        return child.filter(F.col(key).isNull()).unionByName(child.join(ids, key, "left_semi").select(child.columns))
    known = ids.withColumn("_known", F.lit(True))
    return (child.join(known, key, "left").withColumn(key, F.when(F.col("_known"), F.col(key)))
            .drop("_known").select(child.columns))


def apply_file_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Overwrite category, subcategory, tags and status where a patch has them.

    ``patches``: file_id, the four columns (null = keep), ts, patch_id. Patches of
    a file apply in time order, so each column takes its last value given.
    """
    cols = ["category", "subcategory", "tags", "status"]
    order = F.struct("ts", "patch_id")
    last = patches.groupBy("file_id").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in cols])
    out = files.join(last, "file_id", "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def latest_classification(history: DataFrame) -> DataFrame:
    """Newest classification per finding."""
    return latest(history, ["finding_id"], ["created_at", "classification_id"])
