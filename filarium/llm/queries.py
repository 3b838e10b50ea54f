"""Registered queries of the operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann, bpe, hard_negatives, line_dedup, ngram_join, packing, pii, quality_rules, secret_scan, sharding, token_alignment,
               url_filter, warc_zip)
from .common import table

#: Key of the pseudonyms over the test tables; a real one comes from a secret store.
TEST_KEY = b"test tables"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """File of a public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


@query
def op5_line_dedup(spark, sf_dir):
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


@query
def op10_ngram_join(spark, sf_dir):
    return ngram_join.join_groups(table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark, sf_dir):
    return bpe.encode_table(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op4_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), "length", "score", "is_secret")


@query
def op6_url_filter(spark, sf_dir):
    # the number in a page's path is the document it was made from
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("number"), ((F.col("quality") <= 0) | (F.col("toxic") >= 1)).cast("int").alias("poor"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels)


@query
def op7_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op8_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), TEST_KEY)


@query
def op9_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op3_warc(spark, sf_dir):
    found = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.last THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""


@query
def op11_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op13_hard_negatives"] = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT vec_id, label, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM x),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(sum(a.c * b.c) AS BIGINT) AS score
           FROM parts a JOIN parts b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (SELECT * FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.alike
 AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 10
"""
