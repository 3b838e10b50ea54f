"""Structured Streaming forms of the operators (ST1-ST4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from filarium import constants as K
from filarium.operators.classify import classify
from filarium.operators.findings import detect_findings, finding_of


def stream_findings(entries: DataFrame, large_bytes: int = K.LARGE_FILE_BYTES) -> DataFrame:
    """Findings with classification from a stream of entries (ST1); stateless."""
    found = detect_findings(entries, large_bytes).withColumn("finding_type", F.col("type"))
    return classify(found).drop("finding_type")


def stream_files(entries: DataFrame, large_bytes: int = K.LARGE_FILE_BYTES) -> DataFrame:
    """Inventory rows from a stream of entries (ST1)."""
    from filarium.operators.findings import files_table
    kind = finding_of(F.col("name"), F.col("size_bytes"), F.col("extension"), large_bytes)["type"]
    ruled = classify(entries.withColumn("finding_type", kind))
    return files_table(ruled, F.col("ai.category"), F.col("ai.tags"), large_bytes).drop("ai", "finding_type")


def append_scan(findings: DataFrame, out: str, checkpoint: str):
    """Append each micro-batch of findings to parquet (ST1).

    The batch id is part of the path and the batch overwrites it, so a batch that
    is run again after a failure writes the same rows once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_duplicates(hashed: DataFrame) -> DataFrame:
    """Groups with two or more copies seen so far (ST2); use update mode.

    The state per hash is a count and the canonical copy. Both combine before the
    shuffle, so a hash with very many copies is still one small row per task.
    """
    first = F.min(F.struct(F.col("modified_at").isNull().alias("u"), F.col("modified_at").alias("t"),
                           F.col("path").alias("path")))
    return (hashed.filter("size_bytes > 0").groupBy("size_bytes", "hash")
            .agg(F.count("*").alias("copies"), first.alias("_f"))
            .filter("copies > 1").select("size_bytes", "hash", "copies", F.col("_f.path").alias("canonical_path")))


_COPIES = "size_bytes bigint, hash string, copies bigint, canonical_path string, last_seen timestamp"


def recent_duplicates(hashed: DataFrame, keep: str, late: str = "0 seconds", seen: str = "seen_at") -> DataFrame:
    """Groups of copies that come within ``keep`` of each other (ST2); a stream, in update mode.

    A group is emitted when its second copy comes and with every later one. Its state, a count and
    the canonical copy, goes when no copy has come for ``keep`` by the clock of column ``seen``, so the state
    holds the recent hashes only. Rows combine within each batch of a task before they are
    shuffled, so a hash with very many copies is one small row per batch there. ``late`` is how far
    rows may lag behind.
    """
    span = pd.Timedelta(keep)
    parts = ["copies", "modified_at", "path", "first_seen", "last_seen"]
    types = "copies bigint, modified_at timestamp, path string, first_seen timestamp, last_seen timestamp"

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        """Runs of copies that come within ``keep`` of each other; the canonical copy has the oldest time, unknown ones last, then the path."""
        rows = rows.sort_values(["size_bytes", "hash", "first_seen"], kind="stable", ignore_index=True)
        key = [rows["size_bytes"], rows["hash"]]
        until = rows["last_seen"].groupby(key).cummax().groupby(key).shift()
        run = (~(rows["first_seen"] - until <= span)).cumsum().rename("run")
        rows = rows.assign(run=run).sort_values(["run", "modified_at", "path"], na_position="last", kind="stable")
        return rows.groupby("run").agg(size_bytes=("size_bytes", "first"), hash=("hash", "first"), copies=("copies", "sum"),
                                       modified_at=("modified_at", lambda x: x.iloc[0]), path=("path", lambda x: x.iloc[0]),
                                       first_seen=("first_seen", "min"), last_seen=("last_seen", "max"))

    def batches(frames):
        for rows in frames:
            if len(rows):
                yield combine(rows.assign(copies=1))[["size_bytes", "hash", *parts]]

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([*frames], ignore_index=True)
        before = state.get if state.exists else None
        if before:
            known = pd.DataFrame([before], columns=parts).assign(size_bytes=key[0], hash=key[1])
            rows = pd.concat([known.astype(rows.dtypes[known.columns].to_dict()), rows], ignore_index=True)
        runs = combine(rows)
        last = runs.iloc[-1]
        at = None if pd.isna(last["modified_at"]) else last["modified_at"].to_pydatetime()
        state.update((int(last["copies"]), at, last["path"], last["first_seen"].to_pydatetime(), last["last_seen"].to_pydatetime()))
        # the clock of the stream counts from 1970, in UTC as the session does
        due = int((last["last_seen"] + span).tz_localize("UTC").timestamp() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        found = runs[runs["copies"] > 1]
        if before:  # a run that got no copy was emitted before
            found = found[(found["copies"] != before[0]) | (found["first_seen"] != before[3]) | (found["last_seen"] != before[4])]
        if len(found):
            yield found.rename(columns={"path": "canonical_path"})[["size_bytes", "hash", "copies", "canonical_path", "last_seen"]]

    slim = hashed.filter("size_bytes > 0 and hash is not null").select("size_bytes", "hash", "modified_at", "path", F.col(seen).alias("first_seen"),
                                                                       F.col(seen).alias("last_seen"))
    return (slim.mapInPandas(batches, f"size_bytes bigint, hash string, {types}").withWatermark("last_seen", late).groupBy("size_bytes", "hash")
            .applyInPandasWithState(fold, _COPIES, types, "update", "EventTimeTimeout"))


def activity_windows(events: DataFrame, window: str | Column, watermark: str | None = None,
                     slide: str | None = None, session_gap: str | None = None) -> DataFrame:
    """Events per type and time window: tumbling, sliding or session (ST3)."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    w = F.session_window("ts", session_gap) if session_gap else F.window("ts", window, slide or window)
    return (events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events"))


def progress_percent(files: Column, hashed: Column | None = None, to_hash: Column | None = None) -> Column:
    """Estimated percent done while walking, then while hashing (ST4)."""
    if hashed is None:
        return F.least(F.lit(84), F.floor(files / (files + 500) * 85)).cast("int")
    step = F.when(to_hash > 0, F.floor(hashed / to_hash * 14 + 0.5)).otherwise(14)
    return F.least(F.lit(99), 85 + step).cast("int")


def scan_progress(entries: DataFrame, hashing: DataFrame | None = None) -> DataFrame:
    """Running files, folders, bytes and percent per scan (ST4); use update mode.

    ``hashing`` is a second stream (scan_id, to_hash, path): a row with ``to_hash`` says how many files a
    scan is going to hash, any other is a file that was hashed. Both streams meet in one small
    state per scan, which combines before the shuffle; from the first such row on the percent goes on from 85.
    """
    is_file = ~F.col("is_dir")
    rows = entries.select("scan_id", F.when(is_file, 1).otherwise(0).alias("f"), F.when(is_file, 0).otherwise(1).alias("d"),
                          F.when(is_file, F.col("size_bytes")).otherwise(0).alias("b"))
    if hashing is None:
        rows = rows.withColumns({"h": F.lit(0), "t": F.lit(None).cast("bigint")})
    else:
        rows = rows.withColumns({"h": F.lit(0), "t": F.lit(None).cast("bigint")}).unionByName(hashing.select(
            "scan_id", F.lit(0).alias("f"), F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("b"),
            F.when(F.col("to_hash").isNull(), 1).otherwise(0).alias("h"), F.col("to_hash").cast("bigint").alias("t")))
    sums = rows.groupBy("scan_id").agg(F.sum("f").alias("files_scanned"), F.sum("d").alias("folders_scanned"),
                                       F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_scanned"), F.sum("h").alias("_h"), F.max("t").alias("_t"))
    percent = F.when(F.col("_t").isNull(), progress_percent(F.col("files_scanned"))).otherwise(
        progress_percent(F.col("files_scanned"), F.col("_h"), F.col("_t")))
    out = sums.withColumn("progress_percent", percent)
    if hashing is None:
        return out.drop("_h", "_t")
    return out.withColumnsRenamed({"_h": "files_hashed", "_t": "files_to_hash"})
