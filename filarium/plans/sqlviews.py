"""SQL counterparts of the derived views and of the file classifier."""

from __future__ import annotations

from filarium import constants as K
from filarium.functions import re2_regex
from filarium.operators import rules as R
from filarium.operators.classify import RULE_TABLE
from filarium.plans.registry import ins, lst, q
from filarium.sources.views import EXTS, FOLDERS, STEMS


def nth(values, n: str) -> str:
    return f"{lst(values)}[({n}) % {len(values)} + 1]"


EXT_OF = r"regexp_extract(lower(name), '^.+(\.[^.]*)$', 1)"

FILES = f"""files0 AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN doc_id % 41 = 0 THEN 'package.json'
              ELSE {nth(STEMS, 'doc_id')} || '-' || doc_id || {nth(EXTS, 'doc_id')} END AS name
  FROM documents),
files AS (
  SELECT doc_id AS finding_id, doc_id // 250 + 1 AS scan_id, name,
         '/' || source || '/' || lang || '/' || {nth(FOLDERS, 'doc_id // 7')} || '/' || name AS path,
         CASE WHEN doc_id % 97 = 0 THEN 0 ELSE n_chars * 4096 END AS size_bytes,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 525600 AS BIGINT)) AS modified_at,
         {EXT_OF} AS extension, text AS content
  FROM files0)"""

_MB1 = "((size_bytes * 20 + 1048576) // 2097152)"
TYPED = f"""typed AS (
  SELECT *, CASE WHEN size_bytes = 0 THEN 'zero_byte' WHEN extension = '.idlk' THEN 'idlk_file'
                 WHEN extension = '.locked' THEN 'locked_file'
                 WHEN extension IN {ins(K.INSTALLER_EXTS)} THEN 'installer'
                 WHEN extension IN {ins(K.ARCHIVE_EXTS)} THEN 'archive'
                 WHEN size_bytes > {K.LARGE_FILE_BYTES} THEN 'large_file' END AS finding_type
  FROM files)"""

FINDINGS = f"""found AS (
  SELECT finding_id, scan_id, path, name, extension, size_bytes, modified_at, finding_type AS type,
         CASE WHEN finding_type IN ('zero_byte', 'idlk_file') THEN 'safe_delete' ELSE 'review' END AS finding_status,
         CASE finding_type WHEN 'zero_byte' THEN {q(K.REASON_ZERO)} WHEN 'idlk_file' THEN {q(K.REASON_IDLK)}
              WHEN 'locked_file' THEN {q(K.REASON_LOCKED)}
              WHEN 'installer' THEN replace({q(K.REASON_INSTALLER)}, '%1$s', extension)
              WHEN 'archive' THEN replace({q(K.REASON_ARCHIVE)}, '%1$s', extension)
              ELSE replace({q(K.REASON_LARGE)}, '%1$s', {_MB1} // 10 || '.' || {_MB1} % 10) END AS reason,
         CASE WHEN finding_type IN ('zero_byte', 'idlk_file') THEN 'low'
              WHEN finding_type = 'locked_file' THEN 'high' ELSE 'medium' END AS risk_level
  FROM typed WHERE finding_type IS NOT NULL)"""


def _any(col: str, kws) -> str:
    return "regexp_matches({}, {})".format(col, q("|".join(k.replace("-", r"\-").replace(".", r"\.") for k in kws)))


def _kw(col: str, kws) -> str:
    return f"trim(list_filter({lst(kws)}, lambda k: contains({col}, k))[1])"


def _seg_kw(kws) -> str:
    return (f"trim(flatten(list_transform(segs, lambda s: list_filter({lst(kws)}, lambda k: contains(s, k))))[1])")


def _rule_case() -> str:
    fold = {t: _any("folder", k) for t, k in K.FOLDER_KEYWORDS.items()}
    name = {t: _any("lname", k) for t, k in K.NAME_KEYWORDS.items()}
    web = f"(lname IN {ins(K.WEB_NAMES)} OR ext IN {ins(K.WEB_EXTS)})"
    steps = [
        ("finding_type = 'duplicate'", "duplicate"), ("finding_type = 'idlk_file'", "lock_indesign"),
        (f"ext IN {ins(K.LOCK_EXTS)} OR suffix(lname, '.lock')", "lock_application"),
        ("finding_type = 'locked_file'", "locked"),
        (f"ext IN {ins(K.IMAGE_EXTS)} AND regexp_matches(lname, {q(K.SCREENSHOT_PREFIX)})", "screenshot"),
        ("finding_type = 'zero_byte'", "zero_byte"), ("finding_type = 'empty_folder'", "empty_folder"),
        ("finding_type = 'installer'", "installer"), ("finding_type = 'archive'", "archive"),
        (f"ext IN {ins(K.TEMP_EXTS)}", "temporary"),
        ("ext = '.log' AND (contains(lname, 'log') OR list_contains(segs, 'log') OR list_contains(segs, 'logs'))", "log"),
        (f"{web} AND {fold['web']}", "web_folder"), (web, "web"),
        ("ext = '.zip' AND beside_project", "web_zip"),
        (f"ext IN {ins(K.VECTOR_EXTS)} AND ({name['branding']} OR {_any('folder', K.NAME_KEYWORDS['branding'])})", "branding"),
        (f"ext IN {ins(K.DESIGN_EXTS)} AND {fold['design']}", "design_folder"),
        (f"ext IN {ins(K.DESIGN_EXTS)}", "design"), (f"ext IN {ins(K.DOC_EXTS)} AND {fold['design']}", "design_document"),
        (f"ext IN {ins(K.RAW_EXTS)}", "photo_raw"), (f"ext IN {ins(K.IMAGE_EXTS)} AND {fold['photo']}", "photo_folder"),
        (f"ext IN {ins(K.IMAGE_EXTS)}", "photo"), (f"ext IN {ins(K.VIDEO_EXTS)}", "video"),
        (f"ext IN {ins(K.AUDIO_EXTS)}", "audio"), (f"ext IN {ins(K.CODE_EXTS)}", "code")]
    for topic, *_ in K.DOCUMENT_TOPICS:
        hit = f"({name[topic]} OR {fold[topic]})" if topic in fold else name[topic]
        steps.append((f"ext IN {ins(K.DOC_EXTS + K.SHEET_EXTS)} AND {hit}", f"{topic}_document"))
        steps.append((f"ext = '' AND {hit}", f"{topic}_no_extension"))
    steps += [(fold["video"], "video_hint"), (fold["audio"], "audio_hint"), (fold["photo"], "photo_hint"),
              (f"finding_type = 'large_file' AND ext IN {ins(K.VIDEO_EXTS + K.DISK_IMAGE_EXTS)}", "large_image"),
              ("finding_type = 'large_file'", "large")]
    return "CASE " + " ".join(f"WHEN {c} THEN {q(k)}" for c, k in steps) + " ELSE 'unknown' END"


def _kw_case() -> str:
    out = [f"WHEN 'web_folder' THEN {_seg_kw(K.FOLDER_KEYWORDS['web'])}",
           f"WHEN 'branding' THEN coalesce({_kw('lname', K.NAME_KEYWORDS['branding'])}, {_seg_kw(K.NAME_KEYWORDS['branding'])})"]
    for rule, topic in (("design_folder", "design"), ("design_document", "design"), ("photo_folder", "photo"),
                        ("photo_hint", "photo"), ("video_hint", "video"), ("audio_hint", "audio")):
        out.append(f"WHEN {q(rule)} THEN {_seg_kw(K.FOLDER_KEYWORDS[topic])}")
    for topic, *_ in K.DOCUMENT_TOPICS:
        kw = _kw("lname", K.NAME_KEYWORDS[topic])
        if topic in K.FOLDER_KEYWORDS:
            kw = f"coalesce({kw}, {_seg_kw(K.FOLDER_KEYWORDS[topic])})"
        out += [f"WHEN {q(topic + '_document')} THEN {kw}", f"WHEN {q(topic + '_no_extension')} THEN {kw}"]
    return "CASE rule " + " ".join(out) + " END"


def ruled(source: str, name: str = "ruled") -> str:
    """CTEs classifying the rows of ``source``; adds rule, kw, ai_* columns."""
    rows = ", ".join(
        "({}, {}, {}, {}, {}, {}, {}, {}, {})".format(
            q(r[0]), q(r[1]), "NULL" if r[2] is None else q(r[2]), r[3], "NULL" if r[4] is None else q(r[4]),
            q(r[5]), q(r[6]), q(r[9]), lst(r[10])) for r in RULE_TABLE)
    extra = f"{name}_bp AS (SELECT *, FALSE AS beside_project FROM {source})" if source != "beside" else \
        f"{name}_bp AS (SELECT * FROM beside)"
    return f"""{extra},
{name}_0 AS (SELECT *, lower(name) AS lname, lower(extension) AS ext,
   regexp_extract(lower(path), '^(.*)/[^/]*$', 1) AS folder FROM {name}_bp),
{name}_1 AS (SELECT *, string_split(folder, '/') AS segs FROM {name}_0),
{name}_2 AS (SELECT *, {_rule_case()} AS rule FROM {name}_1),
{name}_3 AS (SELECT *, {_kw_case()} AS kw FROM {name}_2),
{name}_rules(rule, category, subcategory, confidence, destination, action_text, rec_action, explanation, tags) AS (VALUES {rows}),
{name} AS (SELECT f.* EXCLUDE (segs), r.category AS ai_category, r.subcategory AS ai_subcategory,
   CAST(r.confidence AS BIGINT) AS ai_confidence, r.destination AS suggested_destination, r.action_text AS suggested_action,
   r.rec_action AS rec_action,
   list_transform(r.tags, lambda t: CASE t WHEN '{{ext}}' THEN replace(f.ext, '.', '') WHEN '{{kw}}' THEN f.kw ELSE t END) AS ai_tags,
   replace(replace(replace(replace(replace(replace(r.explanation, '%1$s', f.ext), '%3$s', CAST((f.size_bytes * 2 + 1048576) // 2097152 AS VARCHAR)),
     '%4$s', coalesce(f.kw, '')), '%5$s', coalesce(nullif(f.ext, ''), f.lname)), '%6$s', coalesce(nullif(f.ext, ''), 'no extension')),
     '%2$s', f.name) AS ai_explanation
  FROM {name}_3 f JOIN {name}_rules r USING (rule))"""


def entity_rows(source: str, key: str, text: str, name: str = "ents") -> str:
    """CTE of (key, type, value) for a text column."""
    found = []
    for kind, pattern, group, ic in K.ENTITY_PATTERNS:
        rx = q(re2_regex(pattern, ic))
        found.append((kind, f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, {rx}, {group}), "
                            f"lambda v: trim(v, e' \\t\\n\\r')), lambda v: v <> ''))"))
    cols = ", ".join(f"{expr} AS {kind}" for kind, expr in found)
    parts = " UNION ALL ".join(
        f"SELECT {key}, {q(kind)} AS type, unnest({kind}) AS value FROM {name}_0" for kind, _ in found if kind != "person")
    return f"""{name}_0 AS (SELECT {key}, {cols} FROM {source}),
{name} AS ({parts} UNION ALL
  SELECT {key}, 'person' AS type, unnest(list_filter(person, lambda p: len(list_filter(organization, lambda o: contains(o, p))) = 0)) AS value FROM {name}_0)"""


ENTRIES = f"""pg AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
   regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS lang, length(html) AS n,
   TIMESTAMP '2024-01-01' + to_hours(CAST(page_id AS BIGINT)) AS modified_at FROM pages),
entries0 AS (
  SELECT '/' || host AS path, host AS name, 0 AS size_bytes, TRUE AS is_dir, modified_at FROM pg
  UNION ALL SELECT '/' || host || '/' || lang, lang, 0, TRUE, modified_at FROM pg
  UNION ALL SELECT '/' || host || '/' || lang || '/drafts-' || page_id % 5, 'drafts-' || page_id % 5, 0, TRUE, modified_at FROM pg
  UNION ALL SELECT '/' || host || '/' || lang || '/page-' || page_id || '.html', 'page-' || page_id || '.html', n, FALSE, modified_at FROM pg
  UNION ALL SELECT '/' || host || '/' || lang || '/drafts-' || page_id % 5 || '/.DS_Store', '.DS_Store', 8, FALSE, modified_at FROM pg WHERE page_id % 3 = 0
  UNION ALL SELECT '/' || host || '/' || lang || '/drafts-' || page_id % 5 || '/note.txt', 'note.txt', 9, FALSE, modified_at FROM pg WHERE page_id % 4 = 0),
entries AS (SELECT path, name, is_dir, CAST(max(size_bytes) AS BIGINT) AS size_bytes, max(modified_at) AS modified_at FROM entries0 GROUP BY ALL)"""

INVENTORY = f"""inventory AS (SELECT l_orderkey AS order_id, l_linenumber AS line,
   'part-' || l_partkey || '-' || l_suppkey || {nth(EXTS, 'l_partkey')} AS name, {nth(EXTS, 'l_partkey')} AS extension,
   {nth(['Legal', 'Banking', 'Design', 'Media', 'Documents', 'Other'], 'l_suppkey')} AS category,
   CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'corrupted' WHEN l_returnflag = 'A' THEN 'action_required'
        WHEN l_returnflag = 'R' THEN 'review' ELSE 'ready' END AS status,
   CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_tax > 0.04 AS tagged, l_linestatus, l_shipdate AS modified_at FROM lineitem)"""

SCANS = """scans AS (SELECT o_orderkey AS scan_id, '/home/user' || o_custkey % 500 AS path,
   CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
   o_orderdate AS started_at,
   CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(CAST(floor(o_totalprice / 100) AS BIGINT)) END AS completed_at,
   CAST(floor(o_totalprice / 10) AS BIGINT) AS files_scanned, o_orderkey % 7 AS duplicates_found,
   o_orderkey % 100 AS progress_percent FROM orders)"""

GROUPS = """grps AS (SELECT p_partkey AS group_id,
   CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS status,
   CAST(floor(p_retailprice * p_size) AS BIGINT) AS total_size_bytes,
   CASE WHEN p_partkey % 3 = 1 THEN CAST(floor(p_retailprice) AS BIGINT) ELSE 0 END AS saved_bytes FROM part)"""

REVIEW = """rev AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 997 END AS finding_id,
   CASE event_type WHEN 'click' THEN 'mark_reviewed' WHEN 'view' THEN 'accept_recommendation'
        WHEN 'purchase' THEN 'reject_recommendation' WHEN 'signup' THEN 'ignore_once' ELSE 'create_rule' END AS action,
   CASE WHEN event_type IN ('click', 'view') THEN 'ignore' ELSE 'unignore' END AS ignore_action, ts FROM events),
revs AS (SELECT *, CASE action WHEN 'accept_recommendation' THEN 'accepted' WHEN 'reject_recommendation' THEN 'rejected'
   WHEN 'ignore_once' THEN 'ignored' ELSE 'reviewed' END AS new_status FROM rev)"""

HASHED = "hashed AS (SELECT *, sha256(content) AS hash FROM files WHERE size_bytes > 0)"
DUPS = """dups AS (SELECT hash, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, min(size_bytes) AS one_copy_bytes,
   count(DISTINCT extension) AS extension_count, min(extension) AS one_ext,
   arg_min(path, (modified_at, path)) AS canonical_path FROM hashed GROUP BY hash HAVING count(*) > 1),
dupr AS (SELECT *, greatest(total_size_bytes - one_copy_bytes, 0) AS wasted_bytes,
   CASE WHEN extension_count > 1 THEN file_count || ' files share identical SHA-256 content across ' || extension_count
        || ' extensions — likely renamed or re-exported copies'
        ELSE file_count || ' files share identical SHA-256 content (' || coalesce(nullif(one_ext, ''), 'no extension') || ')' END AS explanation
   FROM dups)"""
CHUNKS = """chunks AS (SELECT vec_id // 2 AS finding_id, vec_id AS chunk_id, vec_id % 2 AS chunk_index, embedding AS vector, label FROM embeddings)"""
PROJECTS = f"""projects AS (SELECT p_partkey AS project_id, p_name AS name, p_type AS description, 'Brand ' || p_brand AS explanation,
   CASE WHEN p_partkey % 5 = 0 THEN 'archived' ELSE 'active' END AS status, p_size / 51.0::DOUBLE AS confidence FROM part),
links AS (SELECT DISTINCT l_partkey AS project_id, l_orderkey AS finding_id FROM lineitem),
ofind AS (SELECT o_orderkey AS finding_id, {nth(STEMS, 'o_orderkey')} || '-' || o_orderkey || {nth(EXTS, 'o_orderkey')} AS name,
   CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS ai_category,
   CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS modified_at FROM orders),
oents AS (SELECT o_orderkey AS finding_id, 'person' AS type, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey
   UNION ALL SELECT o_orderkey, 'organization', 'Nation ' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
TOPIC_TEXTS = (R.TOPIC_ACTION, R.TOPIC_REASON)
