"""Text analysis, embedding and vector search on small inputs."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filarium import constants as K
from filarium.operators import textops as X, vectors as V

ENTITIES = [
    ("Signed on 2024-05-01 by both parties.", ("date", "2024-05-01")),
    ("Invoice #INV-2024-0091 is due on receipt.", ("invoice_number", "INV-2024-0091")),
    ("Case No. CV-2024-1123 was filed last week.", ("case_reference", "CV-2024-1123")),
    ("Total due: $1,250.00 within 30 days.", ("amount", "$1,250.00")),
    ("John Smith signed on behalf of Acme Corp.", ("person", "John Smith")),
]
LABELS = [
    ("This Agreement is entered into by Plaintiff and Defendant.", "legal"),
    ("Please wire funds using this Account Number: 12345", "banking"),
    ("Card: 4111 1111 1111 1111", "banking"),
    ("Patient diagnosis confirmed by physician.", "medical"),
    ("SSN: 123-45-6789", "identity"),
    ("api_key: sk-abcdefghijklmnopqrstuvwx", "api_key"),
    ("password: hunter2", "password"),
    ("-----BEGIN RSA PRIVATE KEY-----", "private_key"),
    ("ñpassword: hunter2", "password"),
    ("Just a regular grocery list: milk, eggs, bread.", None),
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_entities(spark):
    rows = X.extract_entities(docs(spark, [t for t, _ in ENTITIES])).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.type, r.value))
    for i, (_, expected) in enumerate(ENTITIES):
        assert expected in got[i]
    assert not any(t == "person" and "Acme" in v for t, v in got[4])
    assert any(t == "organization" and "Acme" in v for t, v in got[4])


def test_sensitive_labels(spark):
    rows = docs(spark, [t for t, _ in LABELS]).select("doc_id", X.detect_sensitive(F.col("text")).alias("l")).collect()
    for r in rows:
        expected = LABELS[r.doc_id][1]
        assert (expected in r.l) if expected else r.l == [], LABELS[r.doc_id]


def reference_chunks(text):
    """The chunking rule, written once more in plain Python."""
    import re
    out = []
    for para in filter(None, (p.strip() for p in re.split(r"\n{2,}", text))):
        if len(para) <= 512:
            out.append(para)
            continue
        cur = ""
        for s in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", para))):
            joined = (cur + " " + s).strip()
            if len(joined) <= 512:
                cur = joined
                continue
            if len(cur) >= 20:
                out.append(cur)
            cur = s
            if len(s) > 512:
                out += [p for p in (s[i:i + 512].strip() for i in range(0, len(s), 512)) if len(p) >= 20]
                cur = ""
        if len(cur) >= 20:
            out.append(cur)
    chunks, tail = [], ""
    for i, raw in enumerate(out):
        body = (f"{tail} {raw}" if tail else raw).strip()[:512]
        if len(body) >= 20:
            chunks.append((i, body))
        tail = raw[-80:]
    return chunks



def test_chunks_follow_the_rule(spark):
    texts = ["", "   ", "One short paragraph with some words.", "First paragraph is here now.\n\nSecond paragraph is here now.",
             "This sentence repeats itself many times over. " * 30, "y" * 1300, "short\n\ntiny\n\nA longer paragraph follows here."]
    texts += sample_texts(30)
    got = {}
    for r in X.chunk_text(docs(spark, texts), lossless=False).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_text))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == reference_chunks(t), t[:80]
        assert all(20 <= len(c) <= 512 for _, c in got.get(i, []))


def test_chunks_keep_every_word(spark):
    texts = ["tiny", "short\n\ntiny", "This sentence repeats itself many times over. " * 30 + "Last words here.", "word " * 60_000 + "end", "z" * 1300]
    got = {}
    for r in X.chunk_text(docs(spark, texts)).orderBy("doc_id", "chunk_index").collect():
        assert len(r.chunk_text) <= 512
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    for i, t in enumerate(texts):
        assert got[i][-1].endswith(t.split()[-1][-200:]) and sum(c.count("z") for c in got[i]) >= t.count("z")
        assert sum(len(c.split()) for c in got[i]) >= len(t.split())


def sample_texts(n):
    import random
    rng = random.Random(7)
    parts = ["plumbing", "invoice", "a", "renovation.", "sink!", "x" * 600, "faucet?", "\n", "\n\n", "quarterly", "report"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 150))) for _ in range(n)]


def reference_vector(text):
    import re
    toks = [t for t in (re.sub(r"^['-]+|['-]+$", "", p) for p in re.sub(r"[^a-z0-9\s'-]", " ", text.lower()).split())
            if len(t) >= 2 and t not in K.STOP_WORDS]
    feats = toks + [f"{a}:{b}" for a, b in zip(toks, toks[1:])]

    def fnv(s):
        h = K.FNV_OFFSET
        for c in s:
            h = ((h ^ ord(c)) * K.FNV_PRIME) % 2 ** 32
        return h % 128

    v = np.zeros(128)
    for f in set(feats):
        w = feats.count(f) / len(feats)
        v[fnv(f)] += w
        v[fnv(f + "_b")] += w * 0.5
    n = math.sqrt((v * v).sum())
    return v / n if n else v


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_embedding_equals_the_definition(texts):
    got = V.embed_batch(texts)
    for row, t in zip(got, texts):
        assert np.allclose(row, reference_vector(t), atol=1e-6)
        assert abs((row * row).sum() - 1) < 1e-3 or not row.any()


def test_embedding_is_closer_for_shared_words():
    a, b, c = V.embed_batch(["plumbing invoice bathroom renovation sink", "plumbing quote kitchen renovation faucet",
                             "quarterly financial report revenue growth"])
    assert a @ b > a @ c and not V.embed_batch([""]).any()


def brute_force(chunks, queries, k, floor):
    out = set()
    for qid, qv in queries:
        best = {}
        for fid, cid, v in chunks:
            if v is None or len(v) != len(qv):
                continue
            s = float(np.dot(np.array(v, dtype=np.float32).astype(float), np.array(qv, dtype=np.float32).astype(float)))
            if s >= floor and (fid not in best or (-s, cid) < best[fid]):
                best[fid] = (-s, cid)
        for fid, (s, cid) in sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:k]:
            out.add((qid, fid, cid, round(-s, 9)))
    return out


def vector_tables(spark):
    rng = np.random.default_rng(3)
    chunks = [(i // 3, i, [float(x) for x in rng.normal(size=4 if i % 10 else 3)]) for i in range(120)] + [(99, 999, None)]
    queries = [(q, [float(x) for x in rng.normal(size=4)]) for q in range(5)] + [(7, [1.0, 0.0, 0.0])]
    return (chunks, queries, spark.createDataFrame(chunks, "finding_id long, chunk_id long, vector array<float>"),
            spark.createDataFrame(queries, "query_id long, vector array<float>"))


def test_semantic_search_broadcast_and_tiles_agree_with_brute_force(spark, monkeypatch):
    chunks, queries, c, q = vector_tables(spark)
    expected = brute_force(chunks, queries, 4, 0.05)

    def run():
        return {(r.query_id, r.finding_id, r.chunk_id, round(r.score, 9)) for r in V.semantic_search(c, q, 4, 0.05).collect()}

    assert run() == expected
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "CHUNK_TILE", 30)
    assert run() == expected


def test_best_findings_are_held_over_batches_and_tiles(spark, monkeypatch):
    """Findings with many chunks, equal scores, more tiles than one in a slice, and nothing cut without k."""
    rng = np.random.default_rng(11)
    chunks = [(int(rng.integers(0, 60)), i, [float(x) for x in rng.integers(-2, 3, size=3)]) for i in range(900)]
    queries = [(q, [float(x) for x in rng.integers(-2, 3, size=3)]) for q in range(9)]
    c = spark.createDataFrame(chunks, "finding_id long, chunk_id long, vector array<float>")
    q = spark.createDataFrame(queries, "query_id long, vector array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    monkeypatch.setattr(V, "SCORES", 100)
    try:
        for k in (1, 6, None):
            hits = V.best_chunk(V.score_chunks(c, q, k, 0.05))
            got = {(r.query_id, r.finding_id, r.chunk_id, round(r.score, 9)) for r in (hits if k is None else V.top_hits(hits, k, 0.05)).collect()}
            assert got == brute_force(chunks, queries, k or 1000, 0.05)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert V.score_chunks(c, q.limit(0), 3, 0.05).count() == V.score_chunks(c.limit(0), q, 3, 0.05).count() == 0


def text_index(spark):
    texts = ["the kitchen sink needs a new tap and a new washer soon", "invoice for the bathroom tap and its fitting in spring",
             "holiday photos of the lake and the hills near the border", "", None, "kitchen tap kitchen tap kitchen tap kitchen tap"]
    rows = [(i, 0, i, t) for i, t in enumerate(texts)]
    return texts, V.build_index(spark.createDataFrame(rows, "finding_id long, created_at int, extracted_id long, text string"))


def test_search_texts_gives_passages(spark):
    texts, index = text_index(spark)
    asked = spark.createDataFrame([(1, "kitchen tap"), (2, "LAKE hills"), (3, ""), (4, None), (5, "the of and"), (6, "zzzzqq")], "query_id long, query string")
    got = {}
    for r in V.search_texts(index, asked, k=2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got[1][0].finding_id == 5 and got[2][0].finding_id == 2 and len(got[1]) == 2
    assert all(r.passage == texts[r.finding_id] and r.model == K.EMBED_MODEL for rs in got.values() for r in rs)
    assert not {3, 4, 5} & set(got)
    one = V.search_texts(index, asked, k=2, embedder=V.embed_text(F.lit("lake hills"))).filter("query_id = 6 and rank = 1").first()
    assert one.finding_id == 2


def test_texts_asked_often_are_embedded_once(spark, monkeypatch):
    texts, index = text_index(spark)
    asked = spark.createDataFrame([(i, ["kitchen tap", "LAKE hills"][i % 2]) for i in range(60)], "query_id long, query string")
    met, plain = [], V.semantic_search
    monkeypatch.setattr(V, "semantic_search", lambda index, queries, *a: met.append(queries.count()) or plain(index, queries, *a))
    got = sorted((r.query_id, r.rank, r.finding_id, r.passage) for r in V.search_texts(index, asked, k=2).collect())
    assert met == [2] and {q for q, *_ in got} == set(range(60))
    assert got == sorted((q, r, f, p) for q in range(60) for n, r, f, p in got if n == q % 2)


def test_hybrid_search_blends_both_lists(spark):
    from datetime import datetime

    from filarium.operators import nlquery as N

    _, index = text_index(spark)
    now = datetime(2025, 7, 15)
    names = ["tap-kitchen.pdf", "invoice.pdf", "lake.jpg", "kitchen tap.txt", "old.txt", "note.txt"]
    found = spark.createDataFrame([(i, 1, "none", f"/docs/{n}", n, "." + n[-3:], 10, "low", now, now, None, None) for i, n in enumerate(names)],
                                  "finding_id long, scan_id int, type string, path string, name string, extension string, size_bytes long, risk_level string,"
                                  " modified_at timestamp, created_at timestamp, ai_category string, ai_confidence int")
    ents = spark.createDataFrame([], "finding_id long, type string, value string")
    table = N.interpret_queries(spark.createDataFrame([(1, "kitchen tap"), (2, "lake")], "query_id long, query string"), now)
    rows = {(r.query_id, r.finding_id): r for r in V.hybrid_search(table, found, ents, index, k=10).collect()}
    name_only, both, text_only = rows[1, 3], rows[2, 2], rows[1, 5]
    assert (name_only.semantic_score, name_only.lexical_score, name_only.passage, name_only.model) == (0.0, 1.0, None, None)
    assert both.lexical_score == 1.0 and both.passage.startswith("holiday") and abs(both.combined_score - 0.7 * both.semantic_score - 0.3) < 1e-12
    assert text_only.lexical_score == 0.0 and text_only.combined_score == 0.7 * text_only.semantic_score
    plain = V.hybrid_search(table, found, ents, index, hybrid=False, k=10).collect()
    assert all(r.combined_score == r.semantic_score > 0 for r in plain) and (1, 3) not in {(r.query_id, r.finding_id) for r in plain}


def test_hybrid_merge(spark):
    lex = V.rank_score(spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "query_id long, finding_id long"), ["finding_id"])
    sem = spark.createDataFrame([(0, 2, 10, .85), (0, 4, 11, .70)], "query_id long, finding_id long, chunk_id long, score double")
    rows = {r.finding_id: r for r in V.hybrid_merge(lex, sem, True, 10).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert abs(rows[2].combined_score - (.85 * .7 + (1 - 1 / 3) * .3)) < 1e-9
    assert {r.finding_id for r in V.hybrid_merge(lex, sem, False, 10).collect()} == {2, 4}
    assert V.hybrid_merge(lex, sem, True, 2).count() == 2


def test_summary_and_chunk_ranking(spark):
    df = docs(spark, ["One. Two! Three?", "", "z" * 700])
    got = [r.s for r in df.select(X.summary_of(F.col("text")).alias("s")).collect()]
    assert got == ["One. Two!", K.SUMMARY_EMPTY, "z" * 500]
    c = spark.createDataFrame([(1, 1, 0, "sink and tap", "kitchen sink"), (1, 1, 1, "nothing here", "kitchen sink"), (1, 1, 2, "sink", "kitchen sink")],
                              "doc_id long, query_id long, chunk_index int, chunk_text string, query string")
    assert [r.chunk_index for r in X.top_chunks(c, 2).orderBy("rank").collect()] == [2, 0]


def test_embedding_of_a_very_long_token():
    long = "ab" * 50_000
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(50)]
    mixed = V.embed_batch(texts + [long, f"{long} sink"])
    assert np.allclose(mixed[:50], V.embed_batch(texts)) and np.allclose(mixed[50:], V.embed_batch([long, f"{long} sink"]))
    assert np.allclose((mixed * mixed).sum(axis=1), 1, atol=1e-5)


def test_packed_vectors(spark):
    import struct

    from filarium.sources import files as S
    rows = [(1, [1.0, -2.5]), (2, None), (3, []), (4, [0.1]), (5, [None, 3.0]), (6, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(2)
    packed = df.select("id", S.pack_vector("v").alias("b"))
    got = {r.id: r.b and bytes(r.b) if r.b is not None else None for r in packed.collect()}
    assert got[1] == struct.pack("<2f", 1.0, -2.5) and got[2] is None and got[3] == b"" and got[6] is None
    assert got[4] == struct.pack("<f", 0.1) and got[5][4:] == struct.pack("<f", 3.0) and math.isnan(struct.unpack("<2f", got[5])[0])
    back = {r.id: r.v for r in packed.select("id", S.unpack_vector("b").alias("v")).collect()}
    assert back[1] == [1.0, -2.5] and back[2] is None and back[3] == [] and math.isnan(back[5][0]) and back[5][1] == 3.0
    assert packed.limit(0).select(S.unpack_vector("b").alias("v")).count() == 0


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_index_leaves_single_texts_in_place(spark):
    import random
    r = random.Random(5)
    rows = [(i, 0, i, " ".join("%016x" % r.getrandbits(64) for _ in range(200))) for i in range(300)]
    rows += [(7, 1, 900, "newer text"), (None, 1, 901, "b"), (None, 0, 902, "a")]
    df = spark.createDataFrame(rows, "finding_id long, created_at long, extracted_id long, text string").repartition(4).cache()
    df.count()
    before = shuffled_bytes(spark)
    got = {x.finding_id: x.extracted_id for x in V.build_index(df).select("finding_id", "extracted_id").distinct().collect()}
    assert got == {**{i: i for i in range(300)}, 7: 900, None: 901}
    assert shuffled_bytes(spark) - before < sum(len(x[3]) for x in rows) / 4
    old = {x.finding_id: x.extracted_id for x in V.build_index(df, oldest=True).select("finding_id", "extracted_id").distinct().collect()}
    assert old == {**{i: i for i in range(300)}, None: 902}


def test_search_leaves_other_passages_in_place(spark):
    import random
    r = random.Random(6)
    texts = [" ".join("%016x" % r.getrandbits(64) for _ in range(60)) for _ in range(2000)]
    df = spark.createDataFrame([(i, 0, i, t) for i, t in enumerate(texts)], "finding_id long, created_at long, extracted_id long, text string")
    index = V.build_index(df).cache()
    vectors = index.count() * K.EMBED_DIM * 4
    before = shuffled_bytes(spark)
    queries = spark.createDataFrame([(1, texts[3]), (2, texts[4])], "query_id long, query string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = V.search_texts(index, queries, k=1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {(h.query_id, h.finding_id) for h in hits} == {(1, 3), (2, 4)} and all(h.passage in texts[h.finding_id] for h in hits)
    assert shuffled_bytes(spark) - before < vectors + sum(map(len, texts)) / 4


def test_keys_that_nobody_asks_for_are_not_shuffled(spark):
    from filarium.operators import lookup as L
    rows = spark.range(0, 20_000, 1, 4).withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.xxhash64("id", i).cast("string")))
    asked = rows.filter("id < 50").select(F.col("id").alias("query_id"), F.get("keys", F.lit(3)).alias("_key"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled_bytes(spark)
    try:
        got = L.meet(rows, F.col("keys"), asked, "id").select("query_id", "id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.query_id, r.id) for r in got) == [(i, i) for i in range(50)]
    assert shuffled_bytes(spark) - before < 1_000_000


def test_embedding_memory_does_not_grow_with_the_batch():
    import random
    import tracemalloc
    r = random.Random(7)
    words = ["%05x" % i for i in range(3000)]
    texts = [" ".join(r.choices(words, k=100)) for _ in range(8000)] + [None, ""]
    tracemalloc.start()
    vectors = V.embed_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert (vectors[[5, 7999, 8001]] == V.embed_batch([texts[5], texts[7999], ""])).all()
    assert V.embed_batch([]).shape == (0, K.EMBED_DIM)


def test_entities_in_one_pass_per_pattern(spark):
    """No pattern runs as the hint of another; what a match begins with drops none. A null text has no entities."""
    texts = ["Dec 1, 2024 x2024-05-01 2024-05-01 MAR 3 2024 mar 3 2024 May. 12 2023 1/2/24 é1/2/24", "INV#ABCD-1 inv 2024X Invoice:ZZZZ1 xinv AAAA",
             "DOCKET no. 12345 Matter CV-99999 case abcd mcase 1234", "Ann Lee of Acme Corp. and éAnn Lee aBob Ray Zoë Kim Bob Ray", "$ 5 $1,250.00 $12x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = df.select("doc_id", X.entity_arrays(F.col("text")).alias("e"))
    assert "RLIKE" not in out._jdf.queryExecution().analyzed().toString().upper()
    got = {r.doc_id: [(e.type, e.value) for e in r.e] for r in out.collect()}
    for i, text in enumerate(texts):
        want = {}
        for kind, pattern, group, ic in K.ENTITY_PATTERNS:
            found = [m.group(group).strip() for m in re.finditer(pattern, text or "", re.ASCII | (re.I if ic else 0))]
            want[kind] = list(dict.fromkeys(v for v in found if v))
        want["person"] = [p for p in want["person"] if not any(p in o for o in want["organization"])]
        assert got[i] == [(kind, v) for kind, values in want.items() for v in values], text


def test_tokens_are_found_without_a_loop_over_texts():
    """Tokens of bytes are those of the rule, also around marks and beyond ASCII, and none is handled in Python."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcK '-0\n\tİKßé日_.\U0001F600") for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["the and of", "--'", "-a-b-", "x's the'", "", "être_naïve résumé"]
    for t in texts:
        data = np.frombuffer(t.lower().encode(), np.uint8)
        got = [data[a:a + n].tobytes().decode() for a, n in zip(*V._tokens(data))]
        want = [w.strip("'-") for w in re.split(r"[^a-z0-9'-]+", t.lower())]
        assert got == [w for w in want if len(w) >= 2 and w not in K.STOP_WORDS], t
