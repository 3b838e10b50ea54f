"""Query interpretation and search over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from filarium import constants as K
from filarium.functions import re2_regex
from filarium.operators import nlquery as N, search as S
from filarium.operators.classify import semantic_tags
from filarium.plans import sqlviews as V
from filarium.plans.file_queries import classified
from filarium.plans.registry import lst, q, query, with_
from filarium.session import cut_lineage
from filarium.sources import views

NOW = datetime(2024, 7, 16, 10, 0, 0)
_NOW = "TIMESTAMP '2024-07-16 10:00:00'"

_Q = f"""qs0 AS (SELECT s_suppkey AS k, s_suppkey AS query_id, CAST(CAST(floor(abs(s_acctbal) / 100 + 1) AS BIGINT) AS VARCHAR) AS amount,
   {V.nth(['January', 'march', 'May', 'june', 'Sept', 'December'], 's_nationkey')} AS month, CAST(s_nationkey % 3 + 2023 AS VARCHAR) AS year, s_nationkey FROM supplier),
qs AS (SELECT query_id, ['invoices larger than ' || amount || ' MB from ' || month, 'photos from ' || year, 'PDFs over ' || amount || ' KB',
   'large videos smaller than ' || amount || ' GB', 'duplicate installers from last month', 'documents mentioning Nation ' || s_nationkey,
   'Word docs from this year safe to delete', 'zip files under ' || amount || ' megabytes', 'holiday-' || k, 'legal contracts to review from last week',
   'screenshots from yesterday', 'huge archives in ' || year, 'lock files ' || amount][k % 13 + 1] AS query FROM qs0)"""


def _hits(table, col="q"):
    return "list_filter([" + ", ".join("CASE WHEN {} THEN {} END".format(V._any(col, kws), q(name)) for name, kws in table) + "], lambda x: x IS NOT NULL)"


def _rx(pattern):
    return f"regexp_matches(q, {q(re2_regex(pattern))})"


def _size(p):
    rx = q(re2_regex(p))
    unit = f"substr(regexp_extract(q, {rx}, 2), 1, 1)"
    mult = f"CASE {unit} WHEN 'b' THEN 1 WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776 END"
    return f"CAST(floor(try_cast(replace(regexp_extract(q, {rx}, 1), ',', '') AS DOUBLE) * {mult} + 0.5) AS BIGINT)"


_VAGUE = "greatest(" + ", ".join(f"CASE WHEN {_rx(p)} THEN {b} END" for p, b in K.SIZE_WORDS) + ")"
_EXTS = "list_distinct(flatten(list_filter([" + ", ".join(f"CASE WHEN {_rx(p)} THEN {lst(e)} END" for p, e, _ in K.QUERY_EXTENSIONS) + "], lambda x: x IS NOT NULL)))"
_LABELS = "len(list_filter([" + ", ".join(f"CASE WHEN {_rx(p)} THEN 1 END" for p, _, _ in K.QUERY_EXTENSIONS) + "], lambda x: x IS NOT NULL))"
_STATUSES = "list_filter([" + ", ".join(f"CASE WHEN {_rx(p)} THEN {q(s)} END" for s, p in K.QUERY_STATUSES) + "], lambda x: x IS NOT NULL)"
_MENTION = "coalesce(" + ", ".join("nullif(trim(regexp_extract(trim(query), {}, 1)), '')".format(q(re2_regex(p, True))) for p in K.MENTION_PATTERNS) + ")"
_YEAR = "regexp_extract(q, '\\b(?:in|from|during)?\\s*(20\\d{2}|19\\d{2})\\b', 1)"
_MONTH = f"regexp_extract(q, '\\b(?:from|in|during)?\\s*({K.MONTH_PATTERN})\\b', 1)"
_MNUM = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(mon, 1, 3))"
_DATES = """CASE WHEN regexp_matches(q, 'last\\s+week') THEN [week - 7, week - 1] WHEN regexp_matches(q, 'this\\s+week') THEN [week, today]
   WHEN regexp_matches(q, 'last\\s+month') THEN [CAST(mstart - INTERVAL 1 MONTH AS DATE), mstart - 1] WHEN regexp_matches(q, 'this\\s+month') THEN [mstart, today]
   WHEN regexp_matches(q, 'last\\s+year') THEN [make_date(y - 1, 1, 1), make_date(y - 1, 12, 31)] WHEN regexp_matches(q, 'this\\s+year') THEN [make_date(y, 1, 1), today]
   WHEN yr <> '' THEN [make_date(CAST(yr AS BIGINT), 1, 1), make_date(CAST(yr AS BIGINT), 12, 31)] WHEN mon <> '' THEN [make_date(my, mnum, 1), last_day(make_date(my, mnum, 1))]
   WHEN regexp_matches(q, '\\btoday\\b') THEN [today, today] WHEN regexp_matches(q, '\\byesterday\\b') THEN [today - 1, today - 1] END"""
X11 = f"""nq0 AS (SELECT *, lower(trim(query)) AS q, CAST({_NOW} AS DATE) AS today, CAST(date_trunc('week', {_NOW}) AS DATE) AS week,
   CAST(date_trunc('month', {_NOW}) AS DATE) AS mstart, year({_NOW}) AS y FROM qs),
nq1 AS (SELECT *, {_hits(K.QUERY_CATEGORIES)} AS categories, {_hits(K.QUERY_TYPES)} AS finding_types, {_STATUSES} AS statuses,
   coalesce(greatest({_size(K.SIZE_MIN_PATTERNS[0])}, {_size(K.SIZE_MIN_PATTERNS[1])}), {_VAGUE}) AS min_size_bytes,
   least({_size(K.SIZE_MAX_PATTERNS[0])}, {_size(K.SIZE_MAX_PATTERNS[1])}) AS max_size_bytes,
   {_EXTS} AS extensions, {_LABELS} AS n_ext, {_MENTION} AS mentioned_entity, {_YEAR} AS yr, {_MONTH} AS mon FROM nq0),
nq2 AS (SELECT *, {_MNUM} AS mnum, CASE WHEN {_MNUM} > month({_NOW}) THEN y - 1 ELSE y END AS my FROM nq1),
nq3 AS (SELECT *, {_DATES} AS span FROM nq2),
nq AS (SELECT *, CAST(span[1] AS TIMESTAMP) AS date_from, CAST(span[2] AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59.999 seconds' AS date_to,
   round(least((len(categories) + len(finding_types) + len(statuses) + n_ext + (min_size_bytes IS NOT NULL)::INT + (max_size_bytes IS NOT NULL)::INT
     + (span IS NOT NULL)::INT + (mentioned_entity IS NOT NULL)::INT) / greatest(len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')), 1)::DOUBLE, 1), 2) AS confidence FROM nq3)"""


def interpreted(spark, sf):
    return N.interpret_queries(views.queries_v(spark, sf), NOW)


@query("X11_interpret_queries", with_(_Q, X11, body="""SELECT query_id, array_to_string(categories, ',') AS categories, array_to_string(finding_types, ',') AS finding_types,
  array_to_string(statuses, ',') AS statuses, min_size_bytes, max_size_bytes, array_to_string(list_sort(extensions), ',') AS extensions, date_from, date_to, mentioned_entity, confidence FROM nq"""))
def _(spark, sf):
    i = interpreted(spark, sf)
    arr = {c: F.array_join(c, ",") for c in ("categories", "finding_types", "statuses")}
    arr["extensions"] = F.array_join(F.array_sort("extensions"), ",")
    return i.select("query_id", *[v.alias(c) for c, v in arr.items()], "min_size_bytes", "max_size_bytes", "date_from", "date_to", "mentioned_entity", "confidence")


@query("X11i_X11j_query_explanations")
def _(spark, sf):
    return interpreted(spark, sf).select("query_id", "explanation", "unrecognized_terms", F.size("applied_filters").alias("chips"))


_RES = """rq AS (SELECT query_id, query, categories[1] AS q_category, extensions AS q_extensions, finding_types AS q_types, min_size_bytes AS q_min, max_size_bytes AS q_max,
   date_from AS q_from, date_to AS q_to, mentioned_entity AS q_mention, list_contains(statuses, 'duplicate') AS q_dup,
   CASE WHEN len(categories) = 0 AND len(extensions) = 0 AND len(finding_types) = 0 AND min_size_bytes IS NULL AND NOT list_contains(statuses, 'duplicate') AND mentioned_entity IS NULL
        THEN nullif(trim(query), '') END AS q_plain FROM nq)"""


@query("P8_P9_resolve_filters", with_(_Q, X11, _RES, body="SELECT query_id, q_category, array_to_string(list_sort(q_extensions), ',') AS q_extensions, q_min, q_max, q_dup, q_plain FROM rq"))
def _(spark, sf):
    r = S.resolved_queries(interpreted(spark, sf))
    return r.select("query_id", "q_category", F.array_join(F.array_sort("q_extensions"), ",").alias("q_extensions"), "q_min", "q_max", "q_dup", "q_plain")


# ---- the searched table: classified files ------------------------------------------------

def stored(spark, sf):
    """The classified files as a written table, the way searches find them."""
    return cut_lineage(classified(spark, sf).drop("content"))


def searchable(spark, sf, table=None):
    c = stored(spark, sf) if table is None else table
    kind = F.coalesce("finding_type", F.lit("none"))
    from filarium.operators.findings import risk_level
    return c.select("finding_id", "scan_id", "path", "name", "extension", "size_bytes", "modified_at", "created_at", kind.alias("type"),
                    risk_level(kind, F.when(kind.isin("zero_byte", "idlk_file"), "safe_delete").otherwise("review")).alias("risk_level"),
                    F.col("ai.category").alias("ai_category"), F.col("ai.confidence").alias("ai_confidence"))


def tables(spark, sf):
    """(findings, tags, entities)"""
    t = stored(spark, sf)
    return searchable(spark, sf, t), semantic_tags(t), entities(spark, sf)


def entities(spark, sf):
    d = views.load(spark, sf, "documents")
    n = F.col("doc_id") % 25
    return d.select(F.col("doc_id").alias("finding_id"), F.lit("organization").alias("type"),
                    F.concat(F.lit("Bank of Nation "), n.cast("string"), F.lit(" Ltd")).alias("value"))


_SEARCH = with_(V.FILES, V.TYPED, V.ruled("typed"), """sr AS (SELECT finding_id, scan_id, path, name, extension, size_bytes, modified_at, modified_at AS created_at, coalesce(finding_type, 'none') AS type,
   CASE WHEN finding_type IN ('zero_byte', 'idlk_file') THEN 'low' WHEN finding_type = 'locked_file' THEN 'high' WHEN finding_type IS NOT NULL THEN 'medium' ELSE 'low' END AS risk_level,
   ai_category, ai_confidence, ai_tags, ltrim(lower(extension), '.') AS nx FROM ruled),
st AS (SELECT finding_id, unnest(ai_tags) AS tag FROM sr),
se AS (SELECT doc_id AS finding_id, 'Bank of Nation ' || doc_id % 25 || ' Ltd' AS value FROM documents)""", body="")[:-1]


@query("P3_P5_P6_P7_apply_filters", _SEARCH + """SELECT finding_id FROM sr WHERE path ILIKE '%/src1%' AND nx IN ('pdf', 'docx', 'txt', 'zip', 'csv') AND size_bytes BETWEEN 100000 AND 30000000
  AND modified_at >= TIMESTAMP '2024-01-01 02:00:00' AND modified_at <= TIMESTAMP '2024-01-01 15:00:00'
  AND finding_id IN (SELECT finding_id FROM st WHERE tag ILIKE '%doc%' OR tag ILIKE '%arch%') AND finding_id IN (SELECT finding_id FROM se WHERE value ILIKE '%nation 1%')""")
def _(spark, sf):
    f = {"path": " /SRC1 ", "extensions": [".pdf", "docx", "txt", "zip", "csv"], "min_size_bytes": 100000, "max_size_bytes": 30000000,
         "date_from": "2024-01-01 02:00:00", "date_to": "2024-01-01 15:00:00", "tags": ["doc", "arch"], "mentioned_entity": "nation 1"}
    return S.apply_filters(*tables(spark, sf), f).select("finding_id")


@query("P4_sql_like", "SELECT doc_id FROM documents WHERE text ILIKE '%er_th%' OR text ILIKE '%éé%'")
def _(spark, sf):
    from filarium.functions import sql_like
    d = views.load(spark, sf, "documents")
    return d.filter(sql_like(F.col("text"), "ER_th") | sql_like(F.col("text"), "éé")).select("doc_id")


@query("P6_category_types", _SEARCH + "SELECT finding_id FROM sr WHERE type = 'installer' AND risk_level = 'medium'")
def _(spark, sf):
    return S.apply_filters(*tables(spark, sf), {"category": "Installers", "risk_level": "medium"}).select("finding_id")


@query("J3_with_any_tag", _SEARCH + "SELECT DISTINCT finding_id FROM st WHERE tag ILIKE '%photo%' OR tag ILIKE '%design%'")
def _(spark, sf):
    findings, tags, _ = tables(spark, sf)
    return S.with_any_tag(findings.select("finding_id"), tags, ["photo", "Design"])


@query("J4_mentioning", _SEARCH + "SELECT DISTINCT finding_id FROM se WHERE value ILIKE '%of nation 2%'")
def _(spark, sf):
    return S.mentioning(searchable(spark, sf).select("finding_id"), entities(spark, sf), "of Nation 2")


def _score(qtext, cat, ext, exts, risk, dup):
    """SQL relevance score; arguments are SQL expressions."""
    terms = f"list_filter(regexp_split_to_array(lower(trim({qtext})), '\\s+'), lambda t: length(t) >= 2)"
    hits = f"len(list_filter({terms}, lambda t: contains(lower(name), t)))"
    ql = f"lower(trim({qtext}))"
    return f"""round(least(CASE WHEN s0 = 0 THEN 0.01 ELSE s0 END, 1), 3)""", f"""(CASE WHEN {ql} <> '' AND lower(name) = {ql} THEN 0.5 WHEN {ql} <> '' AND contains(lower(name), {ql}) THEN 0.35
   WHEN {hits} > 0 THEN 0.25 * {hits} / len({terms}) ELSE 0 END
  + CASE WHEN {ql} <> '' AND contains(lower(path), {ql}) THEN 0.1 WHEN len(list_filter({terms}, lambda t: contains(lower(path), t))) > 0 THEN 0.05 ELSE 0 END
  + CASE WHEN ai_category = {cat} THEN 0.2 ELSE 0 END + CASE WHEN ai_confidence >= 90 THEN 0.05 ELSE 0 END + CASE WHEN {dup} AND type = 'duplicate' THEN 0.1 ELSE 0 END
  + CASE WHEN nx = {ext} THEN 0.1 ELSE 0 END + CASE WHEN list_contains({exts}, nx) THEN 0.1 ELSE 0 END + CASE WHEN risk_level = {risk} THEN 0.05 ELSE 0 END)::DOUBLE"""


_FINAL, _RAW = _score("'Invoice Documents 1'", "'Invoices'", "'pdf'", "['pdf', 'txt']", "'low'", "false")


@query("E9_E10_score_findings", _SEARCH + f", s AS (SELECT *, {_RAW} AS s0 FROM sr) SELECT finding_id, {_FINAL} AS relevance_score FROM s")
def _(spark, sf):
    f = {"ai_category": "Invoices", "extension": ".pdf", "extensions": ["pdf", "txt"], "risk_level": "low"}
    return S.score_findings(searchable(spark, sf), "Invoice Documents 1 ", f).select("finding_id", "relevance_score")


_FACTORS = """list_filter([
   CASE WHEN lower(name) = 'invoice documents 1' THEN 'exact filename match "' || name || '"' WHEN contains(lower(name), 'invoice documents 1') THEN 'filename contains "Invoice Documents 1"'
     WHEN len(hits) > 1 THEN 'filename matched terms "' || array_to_string(hits, ', ') || '"' WHEN len(hits) = 1 THEN 'filename matched term "' || hits[1] || '"' END,
   CASE WHEN contains(lower(path), 'invoice documents 1') THEN 'path match' WHEN contains(lower(path), 'invoice') OR contains(lower(path), 'documents') THEN 'partial path match' END,
   CASE WHEN ai_category = 'Invoices' THEN 'AI category: Invoices' END, CASE WHEN nx = 'pdf' THEN '.pdf extension' END,
   CASE WHEN nx IN ('pdf', 'txt') THEN '.' || nx || ' extension' END, CASE WHEN risk_level = 'low' THEN 'risk: low' END], lambda x: x IS NOT NULL)"""


@query("E10_match_explanations", _SEARCH + f""", h AS (SELECT *, list_filter(['invoice', 'documents'], lambda t: contains(lower(name), t)) AS hits FROM sr),
e AS (SELECT *, {_FACTORS} AS factors FROM h)
SELECT finding_id, array_to_string(factors, '; ') AS factors, CASE WHEN len(factors) > 0 THEN 'Ranked because: ' || array_to_string(factors, '; ') || '.' ELSE 'Matched by applied filter.' END
  || CASE WHEN coalesce(ai_category, '') <> '' THEN ' File is classified as "' || ai_category || '"' || CASE WHEN ai_confidence > 0 THEN ' (' || ai_confidence || '% confidence)' ELSE '' END || '.' ELSE '' END AS match_explanation FROM e""")
def _(spark, sf):
    f = {"ai_category": "Invoices", "extension": ".pdf", "extensions": ["pdf", "txt"], "risk_level": "low"}
    s = S.score_findings(searchable(spark, sf), "Invoice Documents 1", f)
    return s.select("finding_id", F.array_join("matched_factors", "; ").alias("factors"), "match_explanation")


@query("T1_numbered_page", _SEARCH + """SELECT finding_id, row_number, total FROM (SELECT finding_id, row_number() OVER (ORDER BY size_bytes DESC, finding_id) AS row_number,
  count(*) OVER () AS total FROM sr) WHERE row_number BETWEEN 301 AND 340""")
def _(spark, sf):
    from filarium.session import checkpoint_path
    out = checkpoint_path(spark, "pages")
    S.write_pages(searchable(spark, sf), [F.desc("size_bytes"), F.asc("finding_id")], out, block=100)
    rows, total = S.read_page(spark, out, 40, 300)
    return rows.select("finding_id", "row_number", F.lit(total).cast("bigint").alias("total"))


_FINAL2, _RAW2 = _score("'invoices over 1 MB'", "'Invoices'", "NULL", "[]::VARCHAR[]", "NULL", "false")


@query("E11_T5_search", _SEARCH + f""", s AS (SELECT *, {_RAW2} AS s0 FROM sr WHERE ai_category = 'Invoices' AND size_bytes >= 1048576)
  SELECT finding_id, {_FINAL2} AS relevance_score, (SELECT count(*) FROM s) AS total FROM s ORDER BY 2 DESC, created_at, finding_id LIMIT 25""")
def _(spark, sf):
    top, total = S.search(*tables(spark, sf), "invoices over 1 MB", NOW, limit=25)
    return top.select("finding_id", "relevance_score").withColumn("total", total.scalar())


_MATCH = """bm AS (SELECT rq.*, sr.* FROM rq JOIN sr ON (q_category IS NULL OR ai_category = q_category) AND (len(q_extensions) = 0 OR list_contains(q_extensions, nx))
  AND (len(q_types) = 0 OR list_contains(q_types, type)) AND (q_min IS NULL OR size_bytes >= q_min) AND (q_max IS NULL OR size_bytes <= q_max)
  AND (q_from IS NULL OR modified_at >= q_from) AND (q_to IS NULL OR modified_at <= q_to) AND (NOT q_dup OR type = 'duplicate')
  AND (q_plain IS NULL OR name ILIKE '%' || q_plain || '%' OR path ILIKE '%' || q_plain || '%')
  WHERE q_mention IS NULL OR finding_id IN (SELECT finding_id FROM se WHERE contains(lower(value), lower(q_mention))))"""


@query("J18_batch_matches", _SEARCH + ", " + _Q + ", " + X11 + ", " + _RES + ", " + _MATCH + " SELECT query_id, finding_id FROM bm")
def _(spark, sf):
    return S.batch_matches(interpreted(spark, sf), searchable(spark, sf), entities(spark, sf)).select("query_id", "finding_id")


@query("J18_T1_batch_totals", _SEARCH + ", " + _Q + ", " + X11 + ", " + _RES + ", " + _MATCH + " SELECT query_id, count(finding_id) AS total FROM rq LEFT JOIN bm USING (query_id) GROUP BY 1")
def _(spark, sf):
    return S.batch_totals(interpreted(spark, sf), searchable(spark, sf), entities(spark, sf))


_FINAL3, _RAW3 = _score("query", "q_category", "NULL", "q_extensions", "NULL", "q_dup")


@query("J18_batch_search", _SEARCH + ", " + _Q + ", " + X11 + ", " + _RES + ", " + _MATCH + f""", s AS (SELECT *, {_RAW3} AS s0 FROM bm), f AS (SELECT query_id, finding_id, created_at, {_FINAL3} AS relevance_score FROM s)
  SELECT query_id, finding_id, relevance_score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, created_at, finding_id) <= 10""")
def _(spark, sf):
    b = S.batch_search(interpreted(spark, sf), searchable(spark, sf), entities(spark, sf), limit=10)
    return b.select("query_id", "finding_id", "relevance_score")
