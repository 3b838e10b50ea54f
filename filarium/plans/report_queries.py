"""Reports, lists, paging and scalar functions over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from filarium import constants as K
from filarium import functions as X
from filarium.operators import reports as R, search as SE
from filarium.plans import sqlviews as V
from filarium.plans.registry import lst, q, query, with_
from filarium.sources import views

NOW = datetime(2001, 6, 15, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2001-06-15 12:00:00'"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor({part} * 1000.0::DOUBLE / {whole} + 0.5) / 10 ELSE 0 END"


A1 = f"""a1 AS (SELECT count(*) AS total_files, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'corrupted') AS corrupted_count,
  {pct("count(*) FILTER (status = 'ready')", 'count(*)')} AS organised_percent FROM inventory)"""
A2 = """a2 AS (SELECT count(*) FILTER (status = 'pending') AS duplicates_count,
  CAST(coalesce(sum(saved_bytes) FILTER (status = 'resolved'), 0) AS BIGINT) AS space_saved_bytes,
  (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM found) AS bytes_recoverable FROM grps)"""
A3 = """act AS (SELECT path, progress_percent FROM scans WHERE status = 'running' ORDER BY scan_id LIMIT 1),
a3 AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM act) THEN 'scanning' WHEN (SELECT count(*) FROM inventory) > 0 THEN 'ready' ELSE 'idle' END AS system_status,
  CAST((SELECT count(*) FROM act) AS INTEGER) AS in_progress_scans,
  (SELECT max(completed_at) FROM scans WHERE status <> 'running') AS last_scan_at,
  (SELECT path FROM act) AS current_scan_path, (SELECT CAST(progress_percent AS INTEGER) FROM act) AS current_scan_progress)"""


def found(spark, sf):
    from filarium.operators.findings import detect_findings
    return detect_findings(views.files_v(spark, sf, False))


@query("A1_file_counts", with_(V.INVENTORY, A1, body="SELECT * FROM a1"))
def _(spark, sf):
    return R.file_counts(views.inventory_v(spark, sf))


@query("A2_recoverable", with_(V.GROUPS, V.FILES, V.TYPED, V.FINDINGS, A2, body="SELECT * FROM a2"))
def _(spark, sf):
    return R.recoverable(views.groups_v(spark, sf), found(spark, sf))


@query("A3_system_status", with_(V.INVENTORY, V.SCANS, A3, body="SELECT * FROM a3"))
def _(spark, sf):
    return R.system_status(views.scans_v(spark, sf), views.inventory_v(spark, sf))


@query("A1_A3_dashboard_summary", with_(V.INVENTORY, V.SCANS, V.GROUPS, V.FILES, V.TYPED, V.FINDINGS, A1, A2, A3, body="SELECT * FROM a1, a2, a3"))
def _(spark, sf):
    return R.dashboard_summary(views.inventory_v(spark, sf), views.groups_v(spark, sf), found(spark, sf), views.scans_v(spark, sf))


_LABELS = ", ".join(f"({q(c)}, {q(t)}, {q(i)})" for c, t, i in K.CATEGORY_LABELS)


@query("A4_P14_category_breakdown", with_(V.INVENTORY, f"labels0(category, label, icon) AS (VALUES {_LABELS})", """per AS (SELECT category, count(*) AS count FROM inventory GROUP BY 1)""",
       body=f"SELECT category, count, {pct('count', '(SELECT sum(count) FROM per)')} AS percent_of_total, coalesce(label, category) AS label, coalesce(icon, '📁') AS icon FROM per LEFT JOIN labels0 USING (category)"))
def _(spark, sf):
    return R.category_breakdown(views.inventory_v(spark, sf))


@query("W8_share_of", with_(V.INVENTORY, "per AS (SELECT category, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inventory GROUP BY 1)",
                           body="SELECT category, bytes, round(bytes / (SELECT max(bytes) FROM per)::DOUBLE, 6) AS share FROM per"))
def _(spark, sf):
    per = views.inventory_v(spark, sf).groupBy("category").agg(F.sum("size_bytes").alias("bytes"))
    return R.share_of(per, "bytes", of="max").withColumn("share", F.round("share", 6))


@query("A5_needs_attention", with_(V.INVENTORY, V.GROUPS, body="""SELECT count(*) FILTER (status = 'corrupted') AS corrupted_files,
  count(*) FILTER (NOT tagged) AS untagged_files, (SELECT count(*) FROM grps WHERE status = 'pending') AS duplicates FROM inventory"""))
def _(spark, sf):
    return R.needs_attention(views.inventory_v(spark, sf), views.groups_v(spark, sf))


@query("P13_untagged", with_(V.INVENTORY, body="SELECT category, count(*) AS n FROM inventory WHERE NOT tagged GROUP BY 1"))
def _(spark, sf):
    return R.untagged(views.inventory_v(spark, sf)).groupBy("category").agg(F.count("*").alias("n"))


@query("A6_file_stats", with_(V.INVENTORY, body="""SELECT count(*) AS total, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) FILTER (status = 'ready') AS ready,
  count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'action_required') AS action_required, count(*) FILTER (status = 'corrupted') AS corrupted FROM inventory"""))
def _(spark, sf):
    return R.file_stats(views.inventory_v(spark, sf))


@query("A7_report_overview", with_(V.INVENTORY, V.GROUPS, V.SCANS, body="""SELECT count(*) AS total_files_indexed, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
  (SELECT count(*) FROM scans) AS total_scans, (SELECT count(*) FROM grps WHERE status = 'resolved') AS duplicates_resolved,
  (SELECT CAST(sum(saved_bytes) AS BIGINT) FROM grps) AS space_saved_bytes FROM inventory"""))
def _(spark, sf):
    return R.report_overview(views.inventory_v(spark, sf), views.scans_v(spark, sf), views.groups_v(spark, sf))


@query("A8_file_type_breakdown", with_(V.INVENTORY, body="SELECT extension, count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM inventory GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def _(spark, sf):
    return R.file_type_breakdown(views.inventory_v(spark, sf))


@query("A9_scan_history_days", with_(V.SCANS, body=f"""SELECT scan_id, strftime(started_at, '%Y-%m-%d') AS date, files_scanned, duplicates_found FROM scans
  WHERE started_at >= {NOW_SQL} - INTERVAL 400 DAY"""))
def _(spark, sf):
    return R.scan_history(views.scans_v(spark, sf), NOW, days=400)


@query("A9_scan_history_last", with_(V.SCANS, body="SELECT scan_id, strftime(started_at, '%Y-%m-%d') AS date, files_scanned, duplicates_found FROM scans ORDER BY started_at DESC, scan_id LIMIT 30"))
def _(spark, sf):
    return R.scan_history(views.scans_v(spark, sf), last=30)


@query("A10_findings_by_type", with_(V.FILES, V.TYPED, V.FINDINGS, body="""SELECT type, finding_status, count(*) AS count, grouping(type) * 2 + grouping(finding_status) AS level
  FROM found GROUP BY GROUPING SETS ((type, finding_status), (type), (finding_status), ())"""))
def _(spark, sf):
    return R.findings_by_type(found(spark, sf)).select("type", "finding_status", "count", "level")


@query("A10_findings_summary", with_(V.FILES, V.TYPED, V.FINDINGS, body="""SELECT count(*) AS total, count(*) FILTER (finding_status = 'safe_delete') AS safe_delete,
  count(*) FILTER (finding_status = 'review') AS review, count(*) FILTER (finding_status = 'duplicate') AS duplicate,
  (SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM found GROUP BY 1)) AS by_type FROM found"""))
def _(spark, sf):
    s = R.findings_summary(found(spark, sf))
    pairs = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return s.withColumn("by_type", F.array_join(pairs, ","))


@query("A20_scan_roots", with_(V.SCANS, body="SELECT path, count(*) AS scan_count, max(started_at) AS last_scanned_at FROM scans GROUP BY 1"))
def _(spark, sf):
    return R.scan_roots(views.scans_v(spark, sf))


@query("A23_scan_durations", with_(V.SCANS, """d AS (SELECT *, epoch_ms(completed_at) - epoch_ms(started_at) AS ms FROM scans)""", body="""SELECT scan_id,
  CASE WHEN ms IS NULL OR ms < 0 THEN '—' WHEN ms < 60000 THEN (ms // 1000) || 's' ELSE (ms // 60000) || 'm ' || (ms // 1000) % 60 || 's' END AS duration,
  CASE WHEN ms > 0 THEN round(files_scanned / (ms / 1000.0::DOUBLE), 3) END AS files_per_second FROM d"""))
def _(spark, sf):
    return R.scan_durations(views.scans_v(spark, sf))


# ---- lists and pages ---------------------------------------------------------------

@query("P1_T1_list_files", with_(V.INVENTORY, body="""SELECT order_id, line, name, size_bytes FROM inventory WHERE category = 'Legal' AND status = 'ready' AND name ILIKE '%part-1%'
  ORDER BY modified_at DESC, order_id, line, name, size_bytes LIMIT 50 OFFSET 10"""))
def _(spark, sf):
    hits = SE.list_files(views.inventory_v(spark, sf), "Legal", "ready", "PART-1")
    return SE.page(hits, [F.desc("modified_at"), "order_id", "line", "name", "size_bytes"], 50, 10).select("order_id", "line", "name", "size_bytes")


@query("P2_list_findings", with_(V.FILES, V.TYPED, V.FINDINGS, body="SELECT finding_id, path, type FROM found WHERE scan_id = 2 AND finding_status = 'review' AND (name ILIKE '%IN%' OR path ILIKE '%IN%')"))
def _(spark, sf):
    return SE.list_findings(found(spark, sf), 2, None, "review", " IN ").select("finding_id", "path", "type")


@query("P12_by_status", with_(V.GROUPS, body="SELECT group_id, status FROM grps WHERE status = 'pending'"))
def _(spark, sf):
    from filarium.operators.paths import by_status
    return by_status(views.groups_v(spark, sf), None, "pending").select("group_id", "status")


@query("T7_most_recent", "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def _(spark, sf):
    e = views.load(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return SE.most_recent(e, "ts", 20, "event_id")


# ---- scalar functions -----------------------------------------------------------------

@query("F1_F5_names_and_paths", with_(V.FILES, body=r"""SELECT finding_id, extension, string_split(path, '/')[-1] AS base, regexp_replace(path, '/[^/]*$', '') AS parent,
  regexp_replace(name, '\.[^.]+$', '') AS stem, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS segment_count,
  regexp_replace(lower(name), '\s+', '-', 'g') AS slug FROM files"""))
def _(spark, sf):
    f, name, path = views.files_v(spark, sf, False), F.col("name"), F.col("path")
    return f.select("finding_id", X.extension(name).alias("extension"), X.basename(path).alias("base"), X.parent(path).alias("parent"),
                    X.stem(name).alias("stem"), F.size(X.segments(path)).cast("bigint").alias("segment_count"), X.slug(name).alias("slug"))


@query("F6_F10_byte_texts", """SELECT l_orderkey AS k, l_linenumber AS line, b, CASE WHEN b >= 1073741824 THEN t(b, 1073741824, 'GB') WHEN b >= 1048576 THEN t(b, 1048576, 'MB')
  WHEN b >= 1024 THEN t(b, 1024, 'KB') ELSE b || ' B' END AS human FROM (SELECT *, CAST(floor(l_extendedprice * l_quantity * l_quantity) AS BIGINT) AS b FROM lineitem)""".replace(
      "t(b, 1073741824, 'GB')", "CASE WHEN b % 1073741824 = 0 THEN CAST(b // 1073741824 AS VARCHAR) ELSE (b * 20 + 1073741824) // 2147483648 // 10 || '.' || (b * 20 + 1073741824) // 2147483648 % 10 END || ' GB'").replace(
      "t(b, 1048576, 'MB')", "CASE WHEN b % 1048576 = 0 THEN CAST(b // 1048576 AS VARCHAR) ELSE (b * 20 + 1048576) // 2097152 // 10 || '.' || (b * 20 + 1048576) // 2097152 % 10 END || ' MB'").replace(
      "t(b, 1024, 'KB')", "CASE WHEN b % 1024 = 0 THEN CAST(b // 1024 AS VARCHAR) ELSE (b * 20 + 1024) // 2048 // 10 || '.' || (b * 20 + 1024) // 2048 % 10 END || ' KB'"))
def _(spark, sf):
    b = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity"))
    return views.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), b.alias("b"), X.human_bytes(b).alias("human"))


@query("F8_F9_status_texts", with_(V.SCANS, body="""SELECT status, CASE status WHEN 'running' THEN 'IN PROGRESS' WHEN 'completed' THEN 'COMPLETE' WHEN 'failed' THEN 'FAILED' END AS label,
  upper(status[1]) || status[2:] AS capital, count(*) AS n FROM scans GROUP BY ALL"""))
def _(spark, sf):
    s = views.scans_v(spark, sf)
    return s.groupBy("status", X.status_label(F.col("status")).alias("label"), X.capitalise(F.col("status")).alias("capital")).agg(F.count("*").alias("n"))


@query("F12_F15_dates", """SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso,
  date_trunc('week', o_orderdate)::TIMESTAMP AS week_start, last_day(o_orderdate)::TIMESTAMP AS month_end,
  round(abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '2001-06-15 12:00:00')) / 86400000.0::DOUBLE, 4) AS days FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    return views.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), X.date_text(d).alias("day"), X.iso_text(d).alias("iso"), F.date_trunc("week", d).alias("week_start"),
        F.last_day(d).cast("timestamp").alias("month_end"), F.round(X.day_distance(d, F.lit(NOW).cast("timestamp")), 4).alias("days"))


@query("F17_E2_fnv1a", """SELECT p_partkey AS k, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT) AS fnv FROM part""")
def _(spark, sf):
    return views.load(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.fnv1a(F.col("p_name")).alias("fnv"))


@query("F18_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return views.load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("F20_U3_set_overlap", f"""SELECT l_orderkey AS k, l_linenumber AS line, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)::DOUBLE, 6) AS jaccard,
  round(2 * len(list_intersect(a, b)) / (len(a) + len(b))::DOUBLE, 6) AS dice FROM (SELECT l_orderkey, l_linenumber,
    list_distinct({lst(['x', 'y', 'z'])} || [l_returnflag, l_linestatus]) AS a, list_distinct(['A', 'O', l_returnflag, 'y']) AS b FROM lineitem)""")
def _(spark, sf):
    a = F.array_distinct(F.array(F.lit("x"), F.lit("y"), F.lit("z"), F.col("l_returnflag"), F.col("l_linestatus")))
    b = F.array_distinct(F.array(F.lit("A"), F.lit("O"), F.col("l_returnflag"), F.lit("y")))
    return views.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"),
                                                    F.round(X.jaccard(a, b), 6).alias("jaccard"), F.round(X.dice(a, b), 6).alias("dice"))


@query("F21_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def _(spark, sf):
    e = views.load(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                    F.try_parse_json("props").isNotNull().alias("valid"))


@query("F7_F11_text_predicates", """SELECT doc_id, regexp_matches(text, 'er[aeiou]{2}n') AS has_match, regexp_extract(text, '([A-Z][a-z]+)[.,]', 1) AS first_word,
  len(regexp_extract_all(text, '[0-9]+')) AS numbers, upper(trim(lang)) AS lang, starts_with(source, 'src1') AS early FROM documents""")
def _(spark, sf):
    d, t = views.load(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", t.rlike("er[aeiou]{2}n").alias("has_match"), F.regexp_extract(t, "([A-Z][a-z]+)[.,]", 1).alias("first_word"),
                    F.size(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))).cast("bigint").alias("numbers"),
                    F.upper(X.trim_ws(F.col("lang"))).alias("lang"), F.col("source").startswith("src1").alias("early"))


@query("F16_F19_numbers_and_nulls", """SELECT o_orderkey AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, round(sqrt(o_totalprice), 4) AS root,
  greatest(100, least(400000, o_totalprice)) AS clamped, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE 'none' END AS priority, o_orderkey % 11 = 0 AS missing FROM orders""")
def _(spark, sf):
    o, k, v = views.load(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    p = F.when(k % 11 != 0, F.col("o_orderpriority"))
    return o.select(k.alias("k"), F.floor(v / 1000).alias("thousands"), F.round(F.sqrt(v), 4).alias("root"),
                    F.greatest(F.lit(100.0), F.least(F.lit(400000.0), v)).alias("clamped"), F.coalesce(p, F.lit("none")).alias("priority"),
                    p.eqNullSafe(F.lit(None)).alias("missing"))


@query("F16_parse_number", """SELECT p_partkey AS k, CAST(p_size * 1234.5::DOUBLE AS DOUBLE) AS n FROM part""")
def _(spark, sf):
    text = F.format_number(F.col("p_size") * 1234.5, 1)  # with thousands commas
    return views.load(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.parse_number(text).alias("n"))


@query("F22_counter_map", """SELECT l_returnflag, string_agg(l_linestatus || '=' || n, ',' ORDER BY l_linestatus) AS counts FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    per = views.load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    m = per.groupBy("l_returnflag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linestatus", "n")))).alias("m"))
    return m.select("l_returnflag", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))
