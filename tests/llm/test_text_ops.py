"""Quality rules, tokens, packing, line dedup, n-gram join."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from brute import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filarium.llm import bpe, line_dedup, ngram_join, packing, quality_rules
from filarium.llm.queries import QUERIES, tokenizer_path


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# ---- quality rules

def check_counts(df, rows):
    got = {r.doc_id: r for r in df.collect()}
    for d, t in rows:
        for k, v in brute.quality_counts(t).items():
            assert got[d][k] == v, (d, k)


def test_quality_query(spark, sf):
    out = QUERIES["op1_quality_rules"](spark, sf)
    rows = docs_of(spark, sf)
    check_counts(out, rows)
    assert out.count() == len(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in out.collect() if r.doc_id in labels and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)


def test_quality_odd(spark, odd_docs, null_ids, no_docs):
    docs, rows = odd_docs
    none = spark.createDataFrame([], "doc_id long, quality int")
    check_counts(quality_rules.quality(docs, none), rows)
    assert quality_rules.quality(null_ids, none).count() == 6
    assert quality_rules.quality(no_docs, none).count() == 0
    kept = quality_rules.keep_good(docs, none)
    assert kept.columns == docs.columns
    good = {d for d, t in rows if not brute.quality_counts(t)["base_failed"]}
    assert {r.doc_id for r in kept.collect()} == good


def test_rules_learn_held_out(spark):
    """Rules from one half of a planted table hold on the other half."""
    rows = []
    for i in range(400):
        poor = i % 5 == 0
        words = prose(i, 60).split()
        rows.append((i, " ".join(w + "###" if poor else w for w in words), int(not poor)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = quality_rules.statistics(df, ["doc_id"])
    rules = quality_rules.learn(quality_rules.labelled_statistics(stats, df.select("doc_id", "quality").where("doc_id < 200")))
    assert 1 <= len(rules) <= 2 and str(rules[0])
    out = quality_rules.judge(stats, rules).where("doc_id >= 200 and not base_failed").collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out)


# ---- tokens

@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


ODD = ["İstanbul ΣΑΣ. don't I'LL we'Ve <|endoftext|>x<|startoftext|> ä b c 日本語 12345 ½ ´` ﬁ z‍z 👩‍👩‍👧 'S Ǆ ß ẞ 각",
       "x" * 3000, "", None, "   \n\t ", "'''''s't're " * 30, "ａｂｃ ①② Å Ω", "a\x00b \x0bq \x1f w", "<|endoftext|>", "<| x |>", "J\u030c A\u030a e\u0301.x", "<|ENDOFTEXT|>", "Word, WORD. a.b;c'S!?"]


def check_tokens(df, rows, library):
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d].n_tokens == len(ids), d
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), d
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), d


def test_bpe_query(spark, sf, library):
    check_tokens(QUERIES["op2_bpe"](spark, sf), docs_of(spark, sf), library)


def test_bpe_odd(spark, odd_docs, null_ids, no_docs, library):
    rows = list(enumerate(ODD))
    check_tokens(bpe.encode_table(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()), rows, library)
    check_tokens(bpe.encode_table(odd_docs[0], tokenizer_path()), odd_docs[1], library)
    assert bpe.encode_table(null_ids, tokenizer_path()).count() == 6
    assert bpe.encode_table(no_docs, tokenizer_path(), with_ids=True).count() == 0


def test_segment_tree_by_plain_merges():
    """The tree takes the same merges as a scan for the leftmost pair of lowest rank."""
    b = bpe.Bpe(tokenizer_path())
    rank = {int(k): int(r) for k, r in zip(b.keys, b.ranks)}
    for word in ["ththaning", "a", "überall", "aaaaaaaaaaaaa", "antidisestablishmentarianism"]:
        sym = [int(b.inner[c]) for c in word.encode()]
        sym[-1] = int(b.last[word.encode()[-1]])
        while True:
            best = min(((rank[x * b.width + y], i) for i, (x, y) in enumerate(zip(sym, sym[1:])) if x * b.width + y in rank), default=None)
            if best is None:
                break
            sym[best[1]:best[1] + 2] = [int(b.made[best[0]])]
        assert b.encode_words([word])[0].tolist() == sym


# ---- packing

def check_packing(rows, docs, library, capacity=packing.CAPACITY):
    want = {}
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[d, k] = (at, len(ids[at:at + capacity]), zlib.crc32(np.array(ids[at:at + capacity], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= capacity
    return len(fill), -(-sum(fill.values()) // capacity)


def test_packing_query(spark, sf, library):
    made, least = check_packing(QUERIES["op7_packing"](spark, sf).collect(), docs_of(spark, sf), library)
    assert made <= 1.02 * least + 1


def test_packing_odd(spark, odd_docs, null_ids, no_docs, library):
    docs, rows = odd_docs
    cut = packing.pieces(docs, tokenizer_path(), with_ids=True)
    packed = packing.pack(cut)
    check_packing(packed.collect(), rows, library)
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == packed.agg({"length": "sum"}).first()[0] and max(len(r.ids) for r in whole) <= 4096
    assert packing.pack(packing.pieces(null_ids, tokenizer_path())).count() == 6
    assert packing.pack(packing.pieces(no_docs, tokenizer_path())).count() == 0


def test_packing_shares(spark):
    """Several shares: sequences stay apart and full enough."""
    df = spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 4096, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, share=500).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(rows) == 3000 and max(fill.values()) <= 4096 and len(fill) <= 1.1 * sum(fill.values()) / 4096


def test_sum_of_squares_by_trial():
    """Each place makes the sum of squares smallest, as trying every gap shows."""
    rng = np.random.default_rng(0)
    s, gaps = packing.Sums(64), {}
    for size in rng.integers(1, 65, 400).tolist():
        def total(change):
            count = dict(gaps)
            for g, d in change:
                if 0 < g < 64:
                    count[g] = count.get(g, 0) + d
            return sum(v * v for v in count.values())
        choices = [g for g, n in gaps.items() if n and g >= size] + [64]
        least = min(total([(g, -1), (g - size, 1)]) for g in choices)
        _, offset = s.place(size)
        gap = 64 - offset
        assert total([(gap, -1), (gap - size, 1)]) == least
        for g, d in ((gap, -1), (gap - size, 1)):
            if 0 < g < 64:
                gaps[g] = gaps.get(g, 0) + d


# ---- near copies

def check_groups(df, rows):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()} == brute.near_groups(rows)


def test_ngram_query(spark, sf):
    check_groups(QUERIES["op10_ngram_join"](spark, sf), docs_of(spark, sf))


def test_ngram_odd(spark, odd_docs, null_ids, no_docs):
    docs, rows = odd_docs
    check_groups(ngram_join.join_groups(docs), rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join_groups(null_ids).collect())
    n, m = len(brute.shingles(prose(1, 200))), len(brute.shingles(prose(9, 50)))
    assert got == sorted([("None", n, "3"), ("3", n, "3"), ("None", 0, "None"), ("3", n, "3"), ("4", m, "4"), ("None", m, "4")])
    assert ngram_join.join_groups(no_docs).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute.near_groups(rows).items() if c == d}


def test_ngram_large_group(spark, monkeypatch):
    """A group of many different near copies, cut into several tiles, and lists beyond the short length."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 16)
    base = prose(4, 150).split()
    rows = []
    for i in range(90):
        w = list(base)
        for k in range(i % 5):
            w[(i * 31 + k * 47) % len(w)] = f"w{i}{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(50 + i, 80)) for i in range(20)]
    check_groups(ngram_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string")), rows)


# ---- lines

def check_lines(df, rows):
    got = {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no) for r in df.collect()}
    assert got == brute.line_keepers(rows)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keeper_doc_id, r.keeper_line_no)) for r in df.collect())


def test_line_query(spark, sf):
    check_lines(QUERIES["op5_line_dedup"](spark, sf), docs_of(spark, sf))


def test_line_odd(spark, odd_docs, null_ids, no_docs):
    docs, rows = odd_docs
    check_lines(line_dedup.line_classes(docs), rows)
    kept = [r for r in line_dedup.line_classes(null_ids).collect() if r.kept]
    assert kept and all(r.doc_id is None for r in kept)
    assert line_dedup.line_classes(no_docs).count() == 0
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    keep = brute.line_keepers(rows)
    want = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if keep.get((d, n), (d, n)) == (d, n)]
        if not any(brute.WORD.search(x) for x in lines) or len(left) == len(lines):
            want[d] = t
        elif any(brute.WORD.search(x) for x in left):
            want[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_fuzzy_lines_found(spark):
    """Planted pairs at a similarity of 0.8 and more are found nearly always, others never."""
    rows = []
    for i in range(150):
        w = prose(i, 60).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:20] + [w[20] + "q"] + w[21:]))]
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, r.keeper_doc_id) for r in got.collect() if not r.kept}
    want = {(a[0], b[0]) for a, b in brute.line_keepers(rows).items() if a != b}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 140


def test_every_character_of_a_line_counts(spark):
    """A line with any one character changed has another set; lines that differ behind the 12th character of a word are kept."""
    zh = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(300))
    lines = ["https://example.com/a/1", "GET /api/v1/items/123456 200", "x = " + "".join(chr(97 + i * i % 23) for i in range(90)), zh]
    rows = [(k, i, x[:i] + "§" + x[i + 1:]) for k, x in enumerate(lines) for i in range(len(x)) if x[i] != " "]
    rows += [(k, -1, x) for k, x in enumerate(lines)]
    sets = {(r.k, r.i): frozenset(r.s) for r in spark.createDataFrame(rows, "k int, i int, x string").select("k", "i", line_dedup.shingles(F.col("x")).alias("s")).collect()}
    assert all(sets[k, i] != sets[k, -1] for k, i in sets if i >= 0)
    texts = ["https://example.com/a/1", "https://example.org/zz/2?q=other", "GET /api/v1/items/123456", "GET /api/v1/items/999999",
             zh, zh[:12] + zh[200:100:-1], zh[:150] + "一" + zh[150:]]
    kept = [r.doc_id for r in line_dedup.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.kept]
    assert sorted(kept) == [0, 1, 2, 3, 4, 5]  # the last one has one character more and goes
    assert line_dedup.line_classes(spark.createDataFrame([(0, "y" * 300_000), (1, "")], "doc_id long, text string")).count() == 1


def test_short_lines_at_the_threshold(spark):
    """Pairs at or just above 0.8 share a band nearly always, however short the lines are."""
    out = []
    for common, only in ((4, 1), (8, 2), (9, 2), (12, 3), (16, 4), (32, 8)):
        sets = [(common, i, [hash((common, i, k)) >> 2 for k in range(common)]) for i in range(1500)]
        out += [(c, i, s, s + [hash((c, i, -1 - k)) >> 2 for k in range(only)]) for c, i, s in sets]
    df = spark.createDataFrame(out, "c int, i int, x array<long>, y array<long>")
    x = line_dedup.with_bands(df.withColumn("hashes", F.col("x")), "c", "i").withColumnRenamed("bands", "p")
    both = x.join(line_dedup.with_bands(df.withColumn("hashes", F.col("y")), "c", "i"), ["c", "i"])
    found = {r.c: r.f for r in both.groupBy("c").agg(F.avg(F.arrays_overlap("p", "bands").cast("int")).alias("f")).collect()}
    print("recall by common hashes:", {k: round(v, 4) for k, v in sorted(found.items())})
    assert len(found) == 6 and min(found.values()) > 0.99, found
