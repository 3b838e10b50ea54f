"""Review workflow and batch forms of the streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from filarium.operators import review as R
from filarium.plans import sqlviews as V
from filarium.plans.file_queries import classified, hashed
from filarium.plans.registry import query, with_
from filarium.sources import views
from filarium.streaming import streams as ST


def findings(spark, sf):
    c = classified(spark, sf)
    return c.select("finding_id", "scan_id", F.coalesce("finding_type", F.lit("none")).alias("type"),
                    F.lit("review").alias("finding_status"), F.lit("new").alias("review_status"),
                    "ai.suggested_action", "ai.suggested_destination")


_F = with_(V.FILES, V.TYPED, V.ruled("typed"), V.REVIEW, body="")[:-1]


@query("R1_review_status", with_(V.REVIEW, body="SELECT action, new_status, count(*) AS n FROM revs GROUP BY ALL"))
def _(spark, sf):
    e = views.review_v(spark, sf)
    return e.groupBy("action", R.review_status(F.col("action")).alias("new_status")).agg(F.count("*").alias("n"))


@query("R2_fold_reviews", _F + """, last AS (SELECT finding_id, new_status, ts FROM revs QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT r.finding_id, coalesce(new_status, 'new') AS review_status, ts AS reviewed_at FROM ruled r LEFT JOIN last USING (finding_id)""")
def _(spark, sf):
    return R.fold_reviews(findings(spark, sf), views.review_v(spark, sf)).select("finding_id", "review_status", F.col("reviewed_at").cast("timestamp"))


@query("R3_W6_review_audit", with_(V.REVIEW, body="SELECT event_id, finding_id, action, coalesce(lag(new_status) OVER (PARTITION BY finding_id ORDER BY ts, event_id), 'new') AS previous_status, new_status FROM revs"))
def _(spark, sf):
    return R.review_audit(views.review_v(spark, sf)).select("event_id", "finding_id", "action", "previous_status", "new_status")


@query("R4_proposed_actions", _F + """SELECT event_id AS action_id, finding_id, CASE WHEN coalesce(suggested_destination, '') <> '' THEN 'move' ELSE 'archive' END AS action_type,
  nullif(suggested_destination, '') AS proposed_destination, suggested_action AS description, CASE WHEN event_id % 5 = 0 THEN 'dismissed' ELSE 'pending' END AS status
  FROM rev JOIN ruled USING (finding_id) WHERE action = 'accept_recommendation'""")
def _(spark, sf):
    ev = views.review_v(spark, sf)
    gone = ev.filter("event_id % 5 = 0").select(F.col("event_id").alias("action_id"))
    return R.proposed_actions(findings(spark, sf), ev, gone).select("action_id", "finding_id", "action_type", "proposed_destination", "description", "status")


@query("R5_fold_ignores", _F + """, last AS (SELECT finding_id, ignore_action FROM rev QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT r.finding_id, CASE WHEN ignore_action = 'ignore' THEN 'ignored' ELSE 'review' END AS finding_status FROM ruled r LEFT JOIN last USING (finding_id)""")
def _(spark, sf):
    ev = views.review_v(spark, sf).withColumn("action", F.col("ignore_action"))
    return R.fold_ignores(findings(spark, sf), ev).select("finding_id", "finding_status")


@query("R6_clear_findings", _F + "SELECT finding_id, (SELECT count(*) FROM ruled WHERE scan_id = 1) AS cleared FROM ruled WHERE scan_id <> 1")
def _(spark, sf):
    left, cleared = R.clear_findings(findings(spark, sf), 1)
    return left.select("finding_id").withColumn("cleared", cleared.scalar())


@query("R7_fail_interrupted", with_(V.SCANS, body="SELECT scan_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status FROM scans"))
def _(spark, sf):
    return R.fail_interrupted(views.scans_v(spark, sf)).select("scan_id", "status")


@query("R8_scan_activity", with_(V.SCANS, """ev AS (SELECT scan_id, 'classification_complete' AS type, 'success' AS status, format('Classification complete — {:,} files scanned', files_scanned) AS message FROM scans WHERE status <> 'failed'
  UNION ALL SELECT scan_id, 'duplicate_found', 'warning', duplicates_found || ' duplicate group' || CASE WHEN duplicates_found > 1 THEN 's' ELSE '' END || ' detected (' || duplicates_found * 2 || ' files)' FROM scans WHERE duplicates_found > 0 AND status <> 'failed'
  UNION ALL SELECT scan_id, 'scan_complete', 'success', format('Scan complete — {:,} files, {} findings', files_scanned, scan_id % 50) FROM scans WHERE status <> 'failed'
  UNION ALL SELECT scan_id, 'error', 'error', 'Scan failed: disk gone' FROM scans WHERE status = 'failed')""", body="SELECT * FROM ev"))
def _(spark, sf):
    s = views.scans_v(spark, sf).withColumn("findings_count", F.col("scan_id") % 50).withColumn("duplicate_files", F.col("duplicates_found") * 2)
    return R.scan_activity(s.withColumn("error_message", F.when(F.col("status") == "failed", "disk gone")))


@query("R9_drop_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, sf):
    docs = views.load(spark, sf, "documents").filter("lang = 'en'")
    return R.drop_orphans(views.load(spark, sf, "labels").select("doc_id", "quality"), docs, "doc_id")


@query("R9_clear_references", "SELECT l.label_row, CASE WHEN d.doc_id IS NULL THEN NULL ELSE l.doc_id END AS doc_id FROM (SELECT doc_id, doc_id * 10 AS label_row FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id AND lang = 'en'")
def _(spark, sf):
    docs = views.load(spark, sf, "documents").filter("lang = 'en'")
    child = views.load(spark, sf, "labels").select((F.col("doc_id") * 10).alias("label_row"), "doc_id")
    return R.drop_orphans(child, docs, "doc_id", set_null=True)


@query("R10_apply_file_patches", """WITH p AS (SELECT event_id, user_id AS file_id, ts, CASE WHEN event_type = 'click' THEN 'Cat' || event_id % 7 END AS category, CASE WHEN event_type = 'view' THEN 'review' END AS status FROM events),
c AS (SELECT file_id, category FROM p WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1),
s AS (SELECT file_id, status FROM p WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS file_id, coalesce(c.category, c_mktsegment) AS category, coalesce(s.status, 'ready') AS status FROM customer LEFT JOIN c ON c.file_id = c_custkey LEFT JOIN s ON s.file_id = c_custkey""")
def _(spark, sf):
    none = F.lit(None)
    files = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("category"), none.cast("string").alias("subcategory"),
                                                     none.cast("array<string>").alias("tags"), F.lit("ready").alias("status"))
    e = views.load(spark, sf, "events")
    patches = e.select(F.col("user_id").alias("file_id"), F.when(F.col("event_type") == "click", F.concat(F.lit("Cat"), (F.col("event_id") % 7).cast("string"))).alias("category"),
                       none.cast("string").alias("subcategory"), none.cast("array<string>").alias("tags"),
                       F.when(F.col("event_type") == "view", "review").alias("status"), "ts", F.col("event_id").alias("patch_id"))
    return R.apply_file_patches(files, patches).select("file_id", "category", "status")


@query("W4_latest_classification", with_(V.REVIEW, body="SELECT finding_id, action AS category, event_id AS classification_id FROM rev QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ts DESC, event_id DESC) = 1"))
def _(spark, sf):
    h = views.review_v(spark, sf).select("finding_id", F.col("action").alias("category"), F.col("ts").alias("created_at"), F.col("event_id").alias("classification_id"))
    return R.latest_classification(h).select("finding_id", "category", "classification_id")


# ---- batch forms of the streams ------------------------------------------------------------

@query("ST1_stream_findings", with_(V.FILES, V.TYPED, "t2 AS (SELECT * FROM typed WHERE finding_type IS NOT NULL)", V.ruled("t2"), body="SELECT finding_id, finding_type AS type, rule, ai_category AS category FROM ruled"))
def _(spark, sf):
    return ST.stream_findings(views.files_v(spark, sf, False)).select("finding_id", "type", "ai.rule", "ai.category")


@query("ST2_stream_duplicates", with_(V.FILES, V.HASHED, V.DUPS, body="SELECT hash, one_copy_bytes AS size_bytes, file_count AS copies, canonical_path FROM dups"))
def _(spark, sf):
    return ST.stream_duplicates(hashed(spark, sf)).select("hash", "size_bytes", "copies", "canonical_path")


def events(spark, sf):
    return views.load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ST3_activity_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events FROM events GROUP BY ALL")
def _(spark, sf):
    return ST.activity_windows(events(spark, sf), "1 hour")


@query("ST3_activity_sliding", """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS w
  FROM events, (VALUES (0), (1)) t(o)) GROUP BY ALL""")
def _(spark, sf):
    return ST.activity_windows(events(spark, sf), "1 hour", slide="30 minutes")


@query("ST3_activity_sessions", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT event_type, min(ts) AS window_start, max(ts) + INTERVAL 20 MINUTE AS window_end, count(*) AS events FROM s GROUP BY event_type, sid""")
def _(spark, sf):
    return ST.activity_windows(events(spark, sf), "1 hour", session_gap="20 minutes")


@query("ST4_scan_progress", with_(V.FILES, body="""SELECT scan_id, count(*) AS files_scanned, CAST(0 AS BIGINT) AS folders_scanned, CAST(sum(size_bytes) AS BIGINT) AS bytes_scanned,
  CAST(least(84, floor(count(*) / (count(*) + 500)::DOUBLE * 85)) AS INTEGER) AS progress_percent FROM files GROUP BY 1"""))
def _(spark, sf):
    return ST.scan_progress(views.files_v(spark, sf, False))


