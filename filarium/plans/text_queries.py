"""Text analysis, chunks and embeddings over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from filarium import constants as K
from filarium.functions import re2_regex
from filarium.operators import index_store as I, textops as X, vectors as E
from filarium.operators.skew import latest
from filarium.plans import sqlviews as V
from filarium.plans.file_queries import TEXTS, contents
from filarium.plans.registry import lst, q, query, with_
from filarium.session import checkpoint_path
from filarium.sources import files as S, views


def docs(spark, sf):
    return S.spread(views.load(spark, sf, "documents").select("doc_id", "text"))


_LABELS = ", ".join(f"CASE WHEN regexp_matches(text, {q(re2_regex(p, ic))}) THEN {q(label)} END" for label, p, ic in K.SENSITIVE_PATTERNS)
# labels and entities of texts that also carry the phrases the documents lack
_EXTRA = ["", " This Agreement is made. ", " Card: 4111 1111 1111 1111 ", " Patient diagnosis 2024-05-01 ", " SSN: 123-45-6789, $1,250.00 ",
          " api_key: sk-abcdefghijklmnopqrstuvwx ", " password: hunter2 Invoice #INV-2024-0091 ", " John Smith of Acme Corp. on Mar 3, 2024 ",
          " Case No. CV-2024-1123 with Blue Sky Ltd and Jane Doe "]
_RICH = f"rich AS (SELECT doc_id, text || {V.nth(_EXTRA, 'doc_id')} || 'end' AS text FROM documents)"


def rich(spark, sf):
    return docs(spark, sf).withColumn("text", F.concat("text", views._nth(_EXTRA, F.col("doc_id")), F.lit("end")))


@query("X1_detect_sensitive", with_(_RICH, body=f"SELECT doc_id, list_aggregate(list_sort(list_distinct(list_filter([{_LABELS}], lambda x: x IS NOT NULL))), 'string_agg', ',') AS labels FROM rich"))
def _(spark, sf):
    labels = F.array_join(F.array_sort(X.detect_sensitive(F.col("text"))), ",")
    return rich(spark, sf).select("doc_id", F.nullif(labels, F.lit("")).alias("labels"))


@query("X2_X3_extract_entities", with_(_RICH, V.entity_rows("rich", "doc_id", "text"), body="SELECT doc_id, type, value FROM ents"))
def _(spark, sf):
    return X.extract_entities(rich(spark, sf))


@query("X4_split_sentences", """WITH m AS (SELECT conv_id, turn, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g') AS t FROM conversations)
SELECT conv_id, turn, len(s) AS sentences, md5(array_to_string(s, chr(1))) AS digest
FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[\\x01\\n]'), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '') AS s FROM m)""")
def _(spark, sf):
    c = views.load(spark, sf, "conversations")
    parts = X.split_sentences(F.col("text"))
    return c.select("conv_id", "turn", F.size(parts).cast("bigint").alias("sentences"), F.md5(F.array_join(parts, "\x01")).alias("digest"))


@query("X5_split_paragraphs", """SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, chr(1))) AS digest
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{2,}'), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '') AS p FROM documents)""")
def _(spark, sf):
    parts = X.split_paragraphs(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(parts).cast("bigint").alias("paragraphs"), F.md5(F.array_join(parts, "\x01")).alias("digest"))


_WS = "e' \\t\\n\\r'"
_STEP = """CASE WHEN length(CASE WHEN split_part(acc, chr(1), 2) = '' THEN s ELSE split_part(acc, chr(1), 2) || ' ' || s END) <= 512
    THEN split_part(acc, chr(1), 1) || chr(1) || CASE WHEN split_part(acc, chr(1), 2) = '' THEN s ELSE split_part(acc, chr(1), 2) || ' ' || s END
  WHEN length(s) > 512 THEN split_part(acc, chr(1), 1) || CASE WHEN length(split_part(acc, chr(1), 2)) >= 20 THEN split_part(acc, chr(1), 2) || chr(2) ELSE '' END
    || array_to_string(list_transform(list_filter(list_transform(range(0, (length(s) + 511) // 512), lambda i: trim(substr(s, CAST(i * 512 + 1 AS BIGINT), 512), WS)), lambda x: length(x) >= 20), lambda x: x || chr(2)), '') || chr(1)
  ELSE split_part(acc, chr(1), 1) || CASE WHEN length(split_part(acc, chr(1), 2)) >= 20 THEN split_part(acc, chr(1), 2) || chr(2) ELSE '' END || chr(1) || s END""".replace("WS", _WS)


def chunk_ctes(source: str, key: str, lossless: bool = False) -> str:
    """CTE ``ck`` with (key, chunk_index, chunk_text) of the texts of ``source``."""
    least, room = (1, "least(80, greatest(0, 511 - length(r[chunk_index + 1])))") if lossless else (20, "80")
    step = _STEP.replace(">= 20", f">= {least}")
    return f"""par AS (SELECT {key}, unnest(paras) AS p, generate_subscripts(paras, 1) AS pi FROM (
    SELECT {key}, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS paras FROM {source})),
sen AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(3), 'g'), '[\\x03\\n]'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ss FROM par),
packed AS (SELECT *, list_reduce(ss, lambda acc, s: {step}, chr(1)) AS st FROM sen),
pcs AS (SELECT {key}, pi, CASE WHEN length(p) <= 512 THEN [p] ELSE list_filter(string_split(split_part(st, chr(1), 1), chr(2)), lambda x: x <> '')
   || CASE WHEN length(split_part(st, chr(1), 2)) >= {least} THEN [split_part(st, chr(1), 2)] ELSE [] END END AS pieces FROM packed),
raw AS (SELECT {key}, flatten(list(pieces ORDER BY pi)) AS r FROM pcs GROUP BY {key}),
ck0 AS (SELECT {key}, unnest(range(0, len(r))) AS chunk_index, r FROM raw),
ck AS (SELECT {key}, CAST(chunk_index AS INTEGER) AS chunk_index, substr(trim(CASE WHEN chunk_index = 0 THEN r[1] ELSE right(r[chunk_index], {room}) || ' ' || r[chunk_index + 1] END, {_WS}), 1, 512) AS chunk_text FROM ck0)"""


@query("X6_X7_W7_UD4_chunk_text", with_(chunk_ctes("documents", "doc_id"), body="SELECT doc_id, chunk_index, chunk_text FROM ck WHERE length(chunk_text) >= 20"))
def _(spark, sf):
    return X.chunk_text(docs(spark, sf), lossless=False)


@query("X7_chunk_whole_text", with_(chunk_ctes("documents", "doc_id", lossless=True), body="SELECT doc_id, chunk_index, chunk_text FROM ck"))
def _(spark, sf):
    return X.chunk_text(docs(spark, sf))


@query("X8_T6_top_chunks", """WITH c AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS toks, list_filter(string_split(lower(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)), ' '), lambda t: length(t) >= 3) AS wanted
  FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations)),
s AS (SELECT conv_id, turn, len(list_filter(toks, lambda t: list_contains(wanted, t))) / greatest(len(toks), 1)::DOUBLE AS score FROM c)
SELECT conv_id, turn, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) <= 3""")
def _(spark, sf):
    c = views.load(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("chunk_text"))
    first = c.groupBy("conv_id").agg(F.min_by("chunk_text", "turn").alias("query"))
    ranked = X.top_chunks(c.withColumnRenamed("turn", "chunk_index").join(first, "conv_id"), 3, ["conv_id"])
    return ranked.select("conv_id", F.col("chunk_index").alias("turn"), F.round("score", 6).alias("score"))


@query("X9_summarize", f"""WITH last AS (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
m AS (SELECT conv_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM last)
SELECT conv_id AS finding_id, coalesce(nullif(substr(parts[1] || coalesce(' ' || parts[2], ''), 1, 500), ''), {q(K.SUMMARY_EMPTY)}) AS summary FROM m""")
def _(spark, sf):
    return X.summarize(views.extracted_v(spark, sf)).select("finding_id", "summary")


_KNOWN = """job AS (SELECT finding_id, t.extractor, CASE WHEN t.extractor = 'pdf' THEN trim(CASE WHEN length(content) >= 2 THEN regexp_replace(content, '[()\\\\]', ' ', 'g') || ' ' ELSE '' END || 'second part', e' \\t\\n\\r') ELSE text END AS text
  FROM texts t JOIN files USING (finding_id))"""
_JOB_LABELS = f"list_aggregate(list_sort(list_distinct(list_filter([{_LABELS}], lambda x: x IS NOT NULL))), 'string_agg', ',')"


@query("X10_extraction_job", with_(V.FILES, TEXTS, _KNOWN, V.entity_rows("job", "finding_id", "text"), "found AS (SELECT finding_id, count(*) AS n FROM ents GROUP BY finding_id)",
       body=f"""SELECT finding_id, extractor, CASE WHEN extractor IS NOT NULL THEN false END AS truncated, coalesce({_JOB_LABELS}, '') AS sensitive_categories, coalesce(n, 0) AS entities,
  CASE WHEN extractor IS NULL THEN 'no extractor for this file type' END AS skip_reason FROM job LEFT JOIN found USING (finding_id)"""))
def _(spark, sf):
    j = X.extraction_job(contents(spark, sf))
    labels = F.coalesce(F.array_join(F.array_sort("sensitive_categories"), ","), F.lit(""))
    return j.select("finding_id", "extractor", "truncated", labels.alias("sensitive_categories"),
                    F.greatest(F.size("entities"), F.lit(0)).cast("bigint").alias("entities"), "skip_reason")


@query("W3_latest_extraction", "SELECT conv_id AS finding_id, turn AS extracted_id, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(spark, sf):
    return X.latest_extraction(views.extracted_v(spark, sf)).select("finding_id", "extracted_id", F.md5("text").alias("digest"))


@query("UD3_extract_with", with_(V.FILES, body="SELECT finding_id, CASE WHEN extension IN ('.jpg', '.png') THEN 'ocr' END AS extractor, CASE WHEN extension IN ('.jpg', '.png') THEN 'seen ' || name END AS text FROM files WHERE extension IN ('.jpg', '.png', '.mp4')"))
def _(spark, sf):
    files = views.files_v(spark, sf).filter(F.col("extension").isin(".jpg", ".png", ".mp4"))
    reader = F.when(F.col("extension").isin(".jpg", ".png"), F.concat(F.lit("seen "), F.col("name")))
    return S.extract_with(files, reader).select("finding_id", "extractor", "text")


_TOK = f"""list_filter(list_transform(string_split(regexp_replace(lower(text), '[^a-z0-9''-]+', ' ', 'g'), ' '), lambda t: regexp_replace(t, '^[''-]+|[''-]+$', '', 'g')),
  lambda t: length(t) >= 2 AND NOT list_contains({lst(K.STOP_WORDS)}, t))"""


@query("E1_tokenize", f"SELECT doc_id, len({_TOK}) AS tokens, md5(coalesce(list_aggregate({_TOK}, 'string_agg', ' '), '')) AS digest FROM documents")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", E.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("A22_term_frequency", f"""WITH t AS (SELECT conv_id, turn, {_TOK} AS toks FROM conversations),
f AS (SELECT conv_id * 1000 + turn AS k, unnest(toks) AS term FROM t UNION ALL
  SELECT conv_id * 1000 + turn, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ':' || toks[i + 1])) FROM t WHERE len(toks) > 1)
SELECT k, term, count(*) AS tf FROM f GROUP BY ALL""")
def _(spark, sf):
    c = views.load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("text").alias("chunk_text"))
    return E.term_frequency(c, "k")


# FNV-1a of each feature and of the feature followed by "_b", then the two buckets
_EMBED = f"""et AS (SELECT doc_id, chunk_index, {_TOK.replace('text', 'chunk_text')} AS toks FROM ck WHERE length(chunk_text) >= 20),
ef AS (SELECT doc_id, chunk_index, toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ':' || toks[i + 1]) AS feats FROM et),
eu AS (SELECT doc_id, chunk_index, len(feats) AS n, unnest(feats) AS f FROM ef),
words0 AS (SELECT DISTINCT f FROM eu),
hashes AS (SELECT f, list_reduce(list_prepend({K.FNV_OFFSET}::BIGINT, list_transform(string_split(f, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * {K.FNV_PRIME}) % 4294967296) AS h FROM words0),
buck AS (SELECT f, h % 128 AS b1, ((xor((xor(h, 95::BIGINT) * {K.FNV_PRIME}) % 4294967296, 98::BIGINT) * {K.FNV_PRIME}) % 4294967296) % 128 AS b2 FROM hashes),
ew AS (SELECT doc_id, chunk_index, b1 AS b, 1.0::DOUBLE / n AS w FROM eu JOIN buck USING (f) UNION ALL SELECT doc_id, chunk_index, b2, 0.5::DOUBLE / n FROM eu JOIN buck USING (f)),
ev AS (SELECT doc_id, chunk_index, b, sum(w) AS v FROM ew GROUP BY ALL)"""


@query("E3_UD2_embed_text", with_(chunk_ctes("documents", "doc_id"), _EMBED, body="""SELECT doc_id, chunk_index, array_to_string(list_sort(list(b)), ',') AS buckets, round(max(v) / sqrt(sum(v * v)), 2) AS largest
  FROM ev GROUP BY ALL UNION ALL SELECT doc_id, chunk_index, '', 0.0 FROM et WHERE len(toks) = 0"""))
def _(spark, sf):
    c = X.chunk_text(docs(spark, sf), lossless=False)
    e = E.embed_with(c, E.embed_text(F.col("chunk_text")), K.EMBED_MODEL)
    used = F.filter(F.transform("vector", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return e.select("doc_id", "chunk_index", F.array_join(F.array_sort(F.transform(used, lambda i: i.cast("string").cast("bigint"))), ",").alias("buckets"),
                    F.round(F.array_max("vector").cast("double"), 2).alias("largest"))


_LAST = "lastx AS (SELECT conv_id AS finding_id, turn AS extracted_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"


@query("E6_build_index", with_(_LAST, chunk_ctes("lastx", "finding_id"), body=f"SELECT finding_id, chunk_index, extracted_id, '{K.EMBED_MODEL}' AS model, 128 AS dimensionality FROM ck JOIN lastx USING (finding_id) WHERE length(chunk_text) >= 20"))
def _(spark, sf):
    return E.build_index(views.extracted_v(spark, sf), lossless=False).select("finding_id", "chunk_index", "extracted_id", "model", "dimensionality")


@query("E6_index_coverage", with_(_LAST, chunk_ctes("lastx", "finding_id"), body="SELECT count(DISTINCT k.finding_id) AS indexed, (SELECT count(*) FROM lastx) - count(DISTINCT k.finding_id) AS skipped FROM ck k WHERE length(chunk_text) >= 20"))
def _(spark, sf):
    x = views.extracted_v(spark, sf)
    return E.index_coverage(x, E.build_index(x, lossless=False))


@query("E6_index_whole_texts", with_(_LAST, chunk_ctes("lastx", "finding_id", lossless=True), body=f"SELECT finding_id, chunk_index, extracted_id, md5(chunk_text) AS passage, '{K.EMBED_MODEL}' AS model, 128 AS dimensionality FROM ck JOIN lastx USING (finding_id)"))
def _(spark, sf):
    return E.build_index(views.extracted_v(spark, sf)).select("finding_id", "chunk_index", "extracted_id", F.md5("chunk_text").alias("passage"), "model", "dimensionality")


@query("E6_coverage_whole_texts", with_(_LAST, chunk_ctes("lastx", "finding_id", lossless=True), body="SELECT count(DISTINCT k.finding_id) AS indexed, (SELECT count(*) FROM lastx) - count(DISTINCT k.finding_id) AS skipped FROM ck k"))
def _(spark, sf):
    x = views.extracted_v(spark, sf)
    return E.index_coverage(x, E.build_index(x))


_REBUILT = f"SELECT finding_id, chunk_index, md5(chunk_text) AS passage, '{K.EMBED_MODEL}' AS model, 128 AS dimensionality FROM ck"


def rebuilt(spark, sf) -> str:
    """Folder of an index of the oldest extractions that was then brought to the newest ones."""
    out, x = checkpoint_path(spark, "index"), views.extracted_v(spark, sf)
    I.update(out, latest(x, ["finding_id"], ["created_at", "extracted_id"], oldest=True))
    I.update(out, x)
    return out


@query("E6_index_rebuilt", with_(_LAST, chunk_ctes("lastx", "finding_id", lossless=True), body=_REBUILT))
def _(spark, sf):
    return I.read(spark, rebuilt(spark, sf)).select("finding_id", "chunk_index", F.md5("chunk_text").alias("passage"), "model", "dimensionality")


@query("E13_index_removed", with_(_LAST, chunk_ctes("lastx", "finding_id", lossless=True), body=_REBUILT + " WHERE finding_id NOT IN (SELECT doc_id FROM labels WHERE toxic >= 1)"))
def _(spark, sf):
    out = rebuilt(spark, sf)
    I.remove(spark, out, views.load(spark, sf, "labels").where("toxic >= 1").select(F.col("doc_id").alias("finding_id")))
    return I.read(spark, out).select("finding_id", "chunk_index", F.md5("chunk_text").alias("passage"), "model", "dimensionality")


@query("A15_index_stats", with_(V.CHUNKS, body="SELECT 'stored' AS model, count(*) AS total_chunks, count(DISTINCT finding_id) AS embedded_findings FROM chunks"))
def _(spark, sf):
    return E.index_stats(views.chunks_v(spark, sf))


@query("J17_coverage", "SELECT doc_id AS finding_id, doc_id IN (SELECT doc_id FROM labels) AS covered FROM documents")
def _(spark, sf):
    f = docs(spark, sf).select(F.col("doc_id").alias("finding_id"))
    other = views.load(spark, sf, "labels").select(F.col("doc_id").alias("finding_id"))
    return (E.coverage(f, other).withColumn("covered", F.lit(True))
            .unionByName(E.coverage(f, other, missing=True).withColumn("covered", F.lit(False))))


@query("E13_purge", with_(V.CHUNKS, body="SELECT finding_id, chunk_id FROM chunks WHERE finding_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    ids = views.load(spark, sf, "labels").select(F.col("doc_id").alias("finding_id"))
    return E.purge(views.chunks_v(spark, sf), ids).select("finding_id", "chunk_id")


# ---- vector search: the first chunk of each label asks -------------------------------------

_QV = "qv AS (SELECT label AS query_id, arg_min(vector, chunk_id) AS qvec FROM chunks GROUP BY label)"
_HITS = """hits AS (SELECT CAST(query_id AS BIGINT) AS query_id, finding_id, chunk_id, list_inner_product(CAST(vector AS DOUBLE[]), CAST(qvec AS DOUBLE[])) AS score FROM chunks, qv),
best AS (SELECT * FROM hits WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id, finding_id ORDER BY score DESC, chunk_id) = 1),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, finding_id) AS rank FROM best QUALIFY rank <= 20)"""


def query_vectors(spark, sf):
    c = views.chunks_v(spark, sf)
    return c.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.min_by("vector", "chunk_id").alias("vector"))


def semantic(spark, sf):
    return E.semantic_search(views.chunks_v(spark, sf), query_vectors(spark, sf))


@query("E4_E5_dot_product", with_(V.CHUNKS, body="SELECT finding_id, round(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 6) AS dot, round(greatest(0, least(1, list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])))), 6) AS cosine FROM chunks a JOIN chunks b USING (finding_id) WHERE a.chunk_index = 0 AND b.chunk_index = 1"))
def _(spark, sf):
    from filarium.functions import cosine01, dot
    c = views.chunks_v(spark, sf)
    a = c.filter("chunk_index = 0").select("finding_id", F.col("vector").alias("a"))
    b = c.filter("chunk_index = 1").select("finding_id", F.col("vector").alias("b"))
    return a.join(b, "finding_id").select("finding_id", F.round(dot(F.col("a"), F.col("b")), 6).alias("dot"),
                                          F.round(cosine01(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("E7_J19_T3_semantic_search", with_(V.CHUNKS, _QV, _HITS, body="SELECT query_id, finding_id, chunk_id, round(score, 6) AS score, rank FROM sem"))
def _(spark, sf):
    return semantic(spark, sf).select("query_id", "finding_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query("W2_best_chunk", with_(V.CHUNKS, _QV, _HITS, body="SELECT query_id, finding_id, chunk_id, round(score, 6) AS score FROM best WHERE score >= 0.05"))
def _(spark, sf):
    scored = E.score_chunks(views.chunks_v(spark, sf), query_vectors(spark, sf), None, 0.05)
    return E.best_chunk(scored).select("query_id", "finding_id", "chunk_id", F.round("score", 6).alias("score"))


# lexical list of each query: its label's findings, longest id first
_LEX = """lex0 AS (SELECT CAST(label AS BIGINT) AS query_id, finding_id FROM chunks WHERE chunk_index = 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY finding_id DESC) <= 15),
lex AS (SELECT *, 1 - (row_number() OVER (PARTITION BY query_id ORDER BY finding_id DESC) - 1) / (count(*) OVER (PARTITION BY query_id))::DOUBLE AS lexical_score FROM lex0)"""


def lexical(spark, sf):
    from pyspark.sql import Window
    c = views.chunks_v(spark, sf).filter("chunk_index = 0").select(F.col("label").cast("bigint").alias("query_id"), "finding_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("finding_id"))
    cut = c.withColumn("r", F.row_number().over(w)).filter("r <= 15").drop("r")
    return E.rank_score(cut, [F.desc("finding_id")])


@query("W5_rank_score", with_(V.CHUNKS, _LEX, body="SELECT query_id, finding_id, round(lexical_score, 6) AS lexical_score FROM lex"))
def _(spark, sf):
    return lexical(spark, sf).withColumn("lexical_score", F.round("lexical_score", 6))


@query("E8_J10_T4_hybrid_merge", with_(V.CHUNKS, _QV, _HITS, _LEX, """m AS (SELECT query_id, finding_id, coalesce(score, 0) AS s, coalesce(lexical_score, 0) AS l, chunk_id FROM sem FULL JOIN lex USING (query_id, finding_id))""",
       body="SELECT query_id, finding_id, chunk_id, round(s, 6) AS semantic_score, round(l, 6) AS lexical_score, round(s * 0.7 + l * 0.3, 6) AS combined_score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s * 0.7 + l * 0.3 DESC, finding_id) <= 20"))
def _(spark, sf):
    m = E.hybrid_merge(lexical(spark, sf), semantic(spark, sf))
    return m.select("query_id", "finding_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic_score", "lexical_score", "combined_score")])


@query("E12_format_scores", with_(V.CHUNKS, _QV, _HITS, body="SELECT query_id, finding_id, round(score, 4) AS score, CAST(round(score * 100) AS INTEGER) || '%' AS score_text FROM sem"))
def _(spark, sf):
    return E.format_scores(semantic(spark, sf), ["score"]).select("query_id", "finding_id", "score", "score_text")
