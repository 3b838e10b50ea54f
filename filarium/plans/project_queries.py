"""Project grouping over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from filarium import constants as K
from filarium.operators import dedup as D, projects as P
from filarium.operators.classify import semantic_tags
from filarium.operators.textops import extract_entities
from filarium.plans import sqlviews as V
from filarium.plans.file_queries import classified, hash_table
from filarium.plans.registry import q, query, with_
from filarium.session import cut_lineage
from filarium.sources import views


# ---- grouping of files ---------------------------------------------------------------

def inputs(spark, sf):
    """(findings, tags, entities, chunks) of the classified files."""
    c = cut_lineage(classified(spark, sf).drop("content"))
    files = views.files_v(spark, sf)
    findings = c.select("finding_id", "scan_id", "path", "name", "modified_at", "size_bytes", F.col("ai.category").alias("ai_category"))
    tags = semantic_tags(c)
    ents = extract_entities(files.select("finding_id", F.coalesce("content", F.lit("")).alias("text")), key="finding_id")
    chunks = views.load(spark, sf, "embeddings").select(F.col("vec_id").alias("finding_id"), F.lit(0).alias("chunk_index"), F.col("embedding").alias("vector"))
    return findings, tags, ents, chunks


def augmented(spark, sf):
    return P.augment_findings(*inputs(spark, sf))


def corrections(spark, sf):
    """Memberships in approved projects and rejected candidates."""
    f = views.files_v(spark, sf, False)
    approved = f.filter("finding_id % 17 = 0").select((F.floor(F.col("finding_id") / 200)).alias("group_id"), "finding_id")
    rejected = f.filter("finding_id % 5 = 0").select((F.floor(F.col("finding_id") / 50)).alias("group_id"), "finding_id")
    return approved, rejected


def linked(spark, sf):
    return P.link_groups(augmented(spark, sf), *corrections(spark, sf))


_AUG = with_(V.FILES, V.TYPED, V.ruled("typed"), V.entity_rows("files", "finding_id", "content", "mentions"),
             "mentioned AS (SELECT finding_id, list_distinct(list(lower(value))) AS ents FROM mentions GROUP BY 1)", """aug AS (SELECT r.finding_id, scan_id, path, name, modified_at, size_bytes, ai_category, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs,
   list_distinct(list_transform(ai_tags, lambda t: lower(t))) AS tags,
   coalesce(ents, []::VARCHAR[]) AS ents,
   list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '\\.[^.]+$', ''), '[\\s\\-_.]+'), lambda t: length(t) >= 2)) AS toks,
   CAST(embedding AS DOUBLE[]) AS vec FROM ruled r LEFT JOIN embeddings e ON e.vec_id = r.finding_id LEFT JOIN mentioned m ON m.finding_id = r.finding_id)""", body="")[:-1]
_SIG = """ (CASE WHEN least(len(a.segs), len(b.segs)) = 0 THEN 0 ELSE len(list_filter(range(1, least(len(a.segs), len(b.segs)) + 1), lambda i: a.segs[1:i] = b.segs[1:i])) / least(len(a.segs), len(b.segs))::DOUBLE END) AS folder_proximity,
  CASE WHEN len(a.tags) + len(b.tags) = 0 THEN 0 ELSE 2 * len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags))::DOUBLE END AS shared_tags,
  CASE WHEN len(a.ents) + len(b.ents) = 0 THEN 0 ELSE 2 * len(list_intersect(a.ents, b.ents)) / (len(a.ents) + len(b.ents))::DOUBLE END AS shared_entities,
  CASE WHEN len(a.toks) + len(b.toks) = 0 THEN 0 ELSE len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))::DOUBLE END AS filename_similarity,
  CASE WHEN a.ai_category = b.ai_category AND a.ai_category <> '' THEN 1.0::DOUBLE ELSE 0 END AS shared_ai_category,
  CASE WHEN d IS NULL THEN 0 WHEN d <= 1 THEN 1 WHEN d <= 7 THEN 0.8::DOUBLE WHEN d <= 30 THEN 0.5 WHEN d <= 90 THEN 0.2 ELSE 0 END AS date_proximity,
  CASE WHEN a.vec IS NULL OR b.vec IS NULL THEN 0 ELSE greatest(0, least(1, list_cosine_similarity(a.vec, b.vec))) END AS semantic_similarity """
_SCORE = "least(" + " + ".join(f"{s} * {w}::DOUBLE" for s, w in K.SIGNAL_WEIGHTS.items()) + ", 1)"
_LINKS = _AUG + f""", pr AS (SELECT a.finding_id AS aid, b.finding_id AS bid, {_SIG.replace('d IS NULL', 'false').replace('d <=', "abs(epoch_ms(a.modified_at) - epoch_ms(b.modified_at)) / 86400000.0::DOUBLE <=")}
  FROM aug a JOIN aug b ON a.finding_id < b.finding_id
  WHERE NOT (a.finding_id % 17 = 0 AND b.finding_id % 17 = 0 AND a.finding_id // 200 = b.finding_id // 200)),
lk AS (SELECT *, {_SCORE} AS score FROM pr WHERE {_SCORE} >= CASE WHEN aid % 5 = 0 AND bid % 5 = 0 AND aid // 50 = bid // 50 THEN 0.35 + 0.15 ELSE 0.35 END),
ed AS (SELECT aid AS x, bid AS y FROM lk UNION ALL SELECT bid, aid FROM lk)"""
_COMP = _LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, reach(node, other) AS (SELECT x, x FROM ed UNION SELECT r.node, e.y FROM reach r JOIN ed e ON r.other = e.x),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query("J2_augment_findings", _AUG + "SELECT finding_id, len(tags) AS tag_count, len(ents) AS entity_count, coalesce(len(vec), 0) AS dimensions FROM aug")
def _(spark, sf):
    return augmented(spark, sf).select("finding_id", F.size("tags").cast("bigint").alias("tag_count"), F.size("entities").cast("bigint").alias("entity_count"),
                                       F.greatest(F.size(F.coalesce("vector", F.array().cast("array<float>"))), F.lit(0)).cast("bigint").alias("dimensions"))


@query("G1_G6_score_pairs", _AUG + ", " + V.HASHED + ", " + V.DUPS + f""", pr AS (SELECT a.finding_id AS aid, b.finding_id AS bid, {_SIG.replace('d IS NULL', 'false').replace('d <=', "abs(epoch_ms(a.modified_at) - epoch_ms(b.modified_at)) / 86400000.0::DOUBLE <=")}
  FROM hashed h JOIN dups USING (hash) JOIN aug b ON b.finding_id = h.finding_id JOIN aug a ON a.path = canonical_path WHERE h.path <> canonical_path)
SELECT aid, bid, round({_SCORE}, 6) AS score, """ + ", ".join(f"round({s}, 6) AS {s}" for s in K.SIGNAL_WEIGHTS) + " FROM pr")
def _(spark, sf):
    # every duplicate against its canonical copy
    h = hash_table(spark, sf)
    copies = D.group_members(D.duplicate_groups(h), h).filter("not is_canonical").select("hash", "finding_id")
    heads = D.group_members(D.duplicate_groups(h), h).filter("is_canonical").select("hash", F.col("finding_id").alias("head"))
    aug = augmented(spark, sf)
    a = aug.select(F.col("finding_id").alias("head"), F.struct("*").alias("a"))
    b = aug.select("finding_id", F.struct("*").alias("b"))
    pairs = copies.join(heads, "hash").join(b, "finding_id").join(a, "head")
    s = P.score_pairs(pairs)
    return s.select(F.col("head").alias("aid"), F.col("finding_id").alias("bid"), F.round("score", 6).alias("score"),
                    *[F.round(f"signals.{n}", 6).alias(n) for n in P.SIGNALS])


@query("J7_J8_J9_G7_project_links", _LINKS + " SELECT count(*) AS links, " + ", ".join(f"round(sum({s}), 3) AS {s}" for s in K.SIGNAL_WEIGHTS) + " FROM lk")
def _(spark, sf):
    g = linked(spark, sf)
    return g.agg(F.sum("links").alias("links"), *[F.round(F.sum(s), 3).alias(s) for s in P.SIGNALS])


@query("G8_components", _COMP + " SELECT node, component FROM comp")
def _(spark, sf):
    return P.components(linked(spark, sf))


_A17 = ", ".join(f"avg({s}) AS {s}" for s in K.SIGNAL_WEIGHTS)


@query("A17_cluster_signals", _COMP + f", cs AS (SELECT component, count(*) AS link_count, {_A17} FROM lk JOIN comp ON node = aid GROUP BY 1) SELECT component, link_count, round({_SCORE}, 5) AS score, "
       + ", ".join(f"round({s}, 5) AS {s}" for s in K.SIGNAL_WEIGHTS) + " FROM cs")
def _(spark, sf):
    g = cut_lineage(linked(spark, sf))
    c = P.cluster_signals(g, P.components(g))
    return c.select("component", "link_count", F.round("score", 5).alias("score"), *[F.round(f"signals.{n}", 5).alias(n) for n in P.SIGNALS])


_FOLD = """mem AS (SELECT component, a.* FROM aug a JOIN comp ON node = finding_id),
sg AS (SELECT component, finding_id, unnest(range(1, len(segs))) AS pos, segs FROM mem),
fold AS (SELECT component, segs[pos] AS segment, count(*) AS n, min((finding_id, pos)) AS first FROM sg GROUP BY ALL),
dom AS (SELECT component, segment FROM fold QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, first) = 1)"""


@query("A19_dominant_folder", _COMP + ", " + _FOLD + " SELECT component, segment FROM dom")
def _(spark, sf):
    findings = inputs(spark, sf)[0]
    comps = P.components(linked(spark, sf)).withColumnRenamed("node", "finding_id")
    return P.dominant_folder(findings.join(comps, "finding_id"))


_PH = "list_filter([" + ", ".join(f"CASE WHEN {s} >= {lim} THEN {q(t)} END" for s, lim, t in K.SIGNAL_PHRASES) + "], lambda x: x IS NOT NULL)"


@query("G9_G10_T8_generate_candidates", _COMP + ", " + _FOLD + f""", cs AS (SELECT component, count(*) AS link_count, {_A17} FROM lk JOIN comp ON node = aid GROUP BY 1),
ph AS (SELECT *, {_PH} AS parts FROM cs), n AS (SELECT component, count(*) AS file_count FROM comp GROUP BY 1)
SELECT component AS candidate_id, 'Project: ' || segment AS name, file_count, link_count, 'pending' AS status,
  CASE WHEN len(parts) = 0 THEN 'Weak multi-signal match' ELSE upper(parts[1][1]) || parts[1][2:] || CASE WHEN len(parts) > 1 THEN ' and ' || len(parts) - 1 || ' other signal' || CASE WHEN len(parts) > 2 THEN 's' ELSE '' END ELSE '' END END AS explanation
  FROM ph JOIN n USING (component) JOIN dom USING (component)""")
def _(spark, sf):
    findings, tags, ents, chunks = inputs(spark, sf)
    rows, _ = P.generate_candidates(findings, tags, ents, chunks, *corrections(spark, sf))
    return rows.select("candidate_id", "name", "file_count", "link_count", "status", "explanation")


# ---- candidates, decisions and projects over the star schema ------------------------------

def cands(spark, sf):
    """Candidates from ``part``; members from ``lineitem``."""
    projects, links, findings = views.projects_v(spark, sf)
    k = F.col("project_id")
    c = projects.select(k.alias("candidate_id"), "name", F.col("confidence").alias("score"), "explanation",
                        F.when(k % 10 == 9, "rejected").otherwise("pending").alias("status"))
    return c, links.withColumnRenamed("project_id", "candidate_id")


def decisions(spark, sf):
    """One decision per four candidates: approve, reject, merge of two, unknown action."""
    k = F.col("candidate_id")
    return cands(spark, sf)[0].filter(k % 4 <= 1).select(
        F.floor(k / 4).alias("decision_id"),
        F.when(k % 12 >= 8, "merge").when(k % 12 >= 4, "reject").otherwise("approve").alias("action"), "candidate_id").filter(
        (F.col("action") == "merge") | (k % 4 == 0))


_CAND = """cand AS (SELECT project_id AS candidate_id, name, confidence AS score, explanation, CASE WHEN project_id % 10 = 9 THEN 'rejected' ELSE 'pending' END AS status FROM projects),
dec0 AS (SELECT candidate_id // 4 AS decision_id, CASE WHEN candidate_id % 12 >= 8 THEN 'merge' WHEN candidate_id % 12 >= 4 THEN 'reject' ELSE 'approve' END AS action, candidate_id FROM cand WHERE candidate_id % 4 <= 1),
dec AS (SELECT * FROM dec0 WHERE action = 'merge' OR candidate_id % 4 = 0),
bad AS (SELECT decision_id, CASE WHEN bool_or(status <> 'pending') THEN 'candidate is not pending' WHEN min(action) = 'merge' AND count(*) < 2 THEN 'a merge needs two candidates' END AS error FROM dec JOIN cand USING (candidate_id) GROUP BY 1),
ok AS (SELECT dec.*, cand.name, cand.score, cand.explanation FROM dec JOIN cand USING (candidate_id) JOIN bad USING (decision_id) WHERE error IS NULL)"""


@query("G11_P12_candidate_states", with_(V.PROJECTS, _CAND, body="SELECT c.candidate_id, CASE o.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'merge' THEN 'merged' ELSE c.status END AS status FROM cand c LEFT JOIN ok o USING (candidate_id)"))
def _(spark, sf):
    return P.apply_project_decisions(*cands(spark, sf), decisions(spark, sf))[0].select("candidate_id", "status")


@query("A18_merge_candidates", with_(V.PROJECTS, _CAND, body="""SELECT decision_id AS project_id, arg_min(name, candidate_id) AS name, round(avg(score), 6) AS confidence,
  CASE WHEN min(action) = 'merge' THEN 'Merged from ' || count(*) || ' candidates.' ELSE min(explanation) END AS explanation FROM ok WHERE action <> 'reject' GROUP BY 1"""))
def _(spark, sf):
    return P.apply_project_decisions(*cands(spark, sf), decisions(spark, sf))[1].select("project_id", "name", F.round("confidence", 6).alias("confidence"), "explanation")


@query("G11_project_links", with_(V.PROJECTS, _CAND, body="SELECT DISTINCT decision_id AS project_id, finding_id FROM ok JOIN links ON project_id = candidate_id WHERE action <> 'reject'"))
def _(spark, sf):
    return P.apply_project_decisions(*cands(spark, sf), decisions(spark, sf))[2].select("project_id", "finding_id")


@query("G11_decision_errors", with_(V.PROJECTS, _CAND, body="SELECT decision_id, error FROM bad WHERE error IS NOT NULL"))
def _(spark, sf):
    return P.apply_project_decisions(*cands(spark, sf), decisions(spark, sf))[3]


@query("J15_candidate_members", with_(V.PROJECTS, _CAND, body="SELECT candidate_id, finding_id, score FROM cand JOIN links ON project_id = candidate_id WHERE status = 'rejected'"))
def _(spark, sf):
    return P.candidate_members(*cands(spark, sf), status="rejected").select("candidate_id", "finding_id", "score")


@query("U4_split_project", with_(V.PROJECTS, body="SELECT CASE WHEN finding_id % 4 = 0 THEN project_id + 1000000 ELSE project_id END AS project_id, finding_id, CASE WHEN finding_id % 4 = 0 THEN 'user' ELSE 'auto' END AS added_by FROM links"))
def _(spark, sf):
    projects, links, _ = views.projects_v(spark, sf)
    moves = links.filter("finding_id % 4 = 0").select("project_id", "finding_id", (F.col("project_id") + 1000000).alias("new_project_id"),
                                                      F.concat(F.lit("Split "), F.col("project_id").cast("string")).alias("new_name"))
    return P.split_project(projects, links.withColumn("added_by", F.lit("auto")), moves)[1].select("project_id", "finding_id", "added_by")


@query("J14_project_counts", with_(V.PROJECTS, body="SELECT p.project_id, count(l.finding_id) AS file_count FROM projects p LEFT JOIN links l USING (project_id) WHERE status = 'active' GROUP BY 1"))
def _(spark, sf):
    projects, links, _ = views.projects_v(spark, sf)
    return P.project_counts(projects, links).select("project_id", "file_count")


@query("J1_project_file_matches", with_(V.PROJECTS, body="SELECT DISTINCT project_id FROM projects JOIN links USING (project_id) JOIN ofind f USING (finding_id) WHERE status = 'active' AND f.name ILIKE '%passport-1%'"))
def _(spark, sf):
    return P.project_file_matches(*views.projects_v(spark, sf), "Passport-1").select("project_id")


_PS = """direct AS (SELECT project_id FROM projects WHERE status = 'active' AND (name ILIKE '%red%' OR description ILIKE '%red%' OR explanation ILIKE '%red%')),
via AS (SELECT DISTINCT project_id FROM projects JOIN links USING (project_id) JOIN ofind f USING (finding_id) WHERE status = 'active' AND f.name ILIKE '%red%'),
hit AS (SELECT project_id, bool_or(d) AS direct FROM (SELECT project_id, true AS d FROM direct UNION ALL SELECT project_id, false FROM via) GROUP BY 1)"""


@query("U2_matched_projects", with_(V.PROJECTS, _PS, body="SELECT project_id, direct FROM hit"))
def _(spark, sf):
    projects, links, findings = views.projects_v(spark, sf)
    from filarium.functions import sql_like
    hit = sql_like(F.col("name"), "red") | sql_like(F.col("description"), "red") | sql_like(F.col("explanation"), "red")
    return P.matched_projects(projects.filter("status = 'active'").filter(hit), P.project_file_matches(projects, links, findings, "red"))


@query("G12_search_projects", with_(V.PROJECTS, _PS, body="""SELECT project_id, name, round(confidence, 3) AS confidence, (SELECT count(*) FROM links l WHERE l.project_id = h.project_id) AS file_count,
  CASE WHEN NOT direct THEN 'Matched via linked file' END AS match_context FROM hit h JOIN projects USING (project_id)"""))
def _(spark, sf):
    return P.search_projects(*views.projects_v(spark, sf), "red").select("project_id", "name", "confidence", "file_count", "match_context")


_MEM = "members AS (SELECT project_id, f.* FROM links JOIN ofind f USING (finding_id))"


def members(spark, sf):
    _, links, findings = views.projects_v(spark, sf)
    return P.project_members(links, findings)


@query("J13_project_members", with_(V.PROJECTS, _MEM, body="SELECT project_id, finding_id, name FROM members"))
def _(spark, sf):
    return members(spark, sf).select("project_id", "finding_id", "name")


_FACETS = """facets AS (SELECT DISTINCT project_id, type AS facet, value FROM members JOIN oents USING (finding_id) UNION SELECT DISTINCT project_id, 'category', ai_category FROM members WHERE ai_category <> '')"""


@query("A13_project_facets", with_(V.PROJECTS, _MEM, _FACETS, body="SELECT project_id, facet, value FROM facets"))
def _(spark, sf):
    return P.project_facets(members(spark, sf), views.order_entities_v(spark, sf))


@query("A13_project_timeline", with_(V.PROJECTS, _MEM, body="SELECT project_id, finding_id, name, modified_at FROM members"))
def _(spark, sf):
    return P.project_timeline(members(spark, sf))


@query("A13_G13_project_rollup", with_(V.PROJECTS, _MEM, _FACETS, """fc AS (SELECT project_id, count(*) FILTER (facet = 'person') AS people, count(*) FILTER (facet = 'organization') AS orgs, count(*) FILTER (facet = 'category') AS categories FROM facets GROUP BY 1)""",
       body="SELECT project_id, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS storage_bytes, min(modified_at) AS first_date, max(modified_at) AS last_date, max(people) AS people, max(orgs) AS orgs, max(categories) AS categories FROM members JOIN fc USING (project_id) GROUP BY 1"))
def _(spark, sf):
    return P.project_rollup(members(spark, sf), views.order_entities_v(spark, sf))


@query("A14_project_categories", with_(V.PROJECTS, _MEM, "per AS (SELECT project_id, ai_category, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM members WHERE ai_category <> '' GROUP BY ALL)",
       body="SELECT project_id, ai_category, file_count, bytes, round(bytes / greatest(max(bytes) OVER (PARTITION BY project_id), 1)::DOUBLE, 6) AS share FROM per"))
def _(spark, sf):
    return P.project_categories(members(spark, sf)).withColumn("share", F.round("share", 6))


