"""Searches from query texts: by meaning, and by meaning and filters together."""

from __future__ import annotations

from pyspark.sql import functions as F

from filarium import constants as K
from filarium.operators import vectors as E
from filarium.plans.registry import query, with_
from filarium.plans.search_queries import _FINAL3, _MATCH, _Q, _RAW3, _RES, _SEARCH, X11, entities, interpreted, searchable
from filarium.plans.text_queries import _TOK, chunk_ctes
from filarium.session import write_table
from filarium.sources import views


def index(spark, sf):
    """Index over the whole texts of the files, as a written table."""
    d = views.load(spark, sf, "documents").select(F.col("doc_id").alias("finding_id"), F.lit(0).alias("created_at"),
                                                  F.col("doc_id").alias("extracted_id"), "text")
    return write_table(E.build_index(d), "index")


# vectors of chunks and queries: counts by FNV bucket, made unit vectors of single precision
_VECTORS = f"""asked AS (SELECT query_id, query FROM nq),
txt AS (SELECT 'c' AS kind, doc_id AS id, chunk_index AS place, chunk_text AS text FROM ck UNION ALL SELECT 'q', query_id, 0, query FROM asked),
tk AS (SELECT kind, id, place, {_TOK} AS toks FROM txt),
ft AS (SELECT kind, id, place, unnest(toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ':' || toks[i + 1])) AS f FROM tk),
words0 AS (SELECT DISTINCT f FROM ft),
hashes AS (SELECT f, list_reduce(list_prepend({K.FNV_OFFSET}::BIGINT, list_transform(string_split(f, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * {K.FNV_PRIME}) % 4294967296) AS h FROM words0),
buck AS (SELECT f, h % 128 AS b1, ((xor((xor(h, 95::BIGINT) * {K.FNV_PRIME}) % 4294967296, 98::BIGINT) * {K.FNV_PRIME}) % 4294967296) % 128 AS b2 FROM hashes),
bw AS (SELECT kind, id, place, b1 AS b, 1.0::DOUBLE AS w FROM ft JOIN buck USING (f) UNION ALL SELECT kind, id, place, b2, 0.5::DOUBLE FROM ft JOIN buck USING (f)),
bv AS (SELECT kind, id, place, b, sum(w) AS v FROM bw GROUP BY ALL),
nv AS (SELECT *, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY kind, id, place)) AS FLOAT) AS DOUBLE) AS x FROM bv),
hit0 AS (SELECT q.id AS query_id, c.id AS finding_id, c.place AS chunk_index, round(sum(q.x * c.x), 9) AS score FROM nv q JOIN nv c ON q.b = c.b AND q.kind = 'q' AND c.kind = 'c' GROUP BY ALL),
best AS (SELECT * FROM hit0 WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id, finding_id ORDER BY score DESC, chunk_index) = 1),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, finding_id) AS rank FROM best QUALIFY rank <= 20)"""


@query("E7_search_texts", with_(_Q, X11, chunk_ctes("documents", "doc_id", lossless=True), _VECTORS,
       body=f"""SELECT query_id, finding_id, sem.chunk_index, round(score, 6) AS score, rank, md5(chunk_text) AS passage, '{K.EMBED_MODEL}' AS model
  FROM sem JOIN ck ON ck.doc_id = finding_id AND ck.chunk_index = sem.chunk_index"""))
def _(spark, sf):
    hits = E.search_texts(index(spark, sf), views.queries_v(spark, sf))
    return hits.select("query_id", "finding_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.round("score", 6).alias("score"),
                       F.col("rank").cast("bigint").alias("rank"), F.md5("passage").alias("passage"), "model")


@query("E8_hybrid_search", _SEARCH + ", " + _Q + ", " + X11 + ", " + _RES + ", " + _MATCH + ", " + chunk_ctes("documents", "doc_id", lossless=True) + ", " + _VECTORS
       + f""", s AS (SELECT *, {_RAW3} AS s0 FROM bm), f AS (SELECT query_id, finding_id, created_at, {_FINAL3} AS relevance_score FROM s),
listed AS (SELECT query_id, finding_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, created_at, finding_id) AS pos FROM f QUALIFY pos <= 15),
lex AS (SELECT *, 1 - (pos - 1) / (count(*) OVER (PARTITION BY query_id))::DOUBLE AS lexical_score FROM listed),
m AS (SELECT query_id, finding_id, chunk_index, coalesce(score, 0) AS s, coalesce(lexical_score, 0) AS l FROM sem FULL JOIN lex USING (query_id, finding_id))
SELECT query_id, finding_id, CAST(m.chunk_index AS INTEGER) AS chunk_index, round(s, 6) AS semantic_score, round(l, 6) AS lexical_score, round(s * 0.7 + l * 0.3, 6) AS combined_score, md5(chunk_text) AS passage,
  row_number() OVER (PARTITION BY query_id ORDER BY s * 0.7 + l * 0.3 DESC, finding_id) AS rank
  FROM m LEFT JOIN ck ON ck.doc_id = finding_id AND ck.chunk_index = m.chunk_index QUALIFY rank <= 20""")
def _(spark, sf):
    out = E.hybrid_search(interpreted(spark, sf), searchable(spark, sf), entities(spark, sf), index(spark, sf), lexical_limit=15)
    return out.select("query_id", "finding_id", F.col("chunk_index").cast("int").alias("chunk_index"),
                      *[F.round(c, 6).alias(c) for c in ("semantic_score", "lexical_score", "combined_score")],
                      F.md5("passage").alias("passage"), F.col("rank").cast("bigint").alias("rank"))
