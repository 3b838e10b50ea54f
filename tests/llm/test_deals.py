"""Sharding, token alignment and hard negatives against plain versions, and their odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filarium.llm import ann, hard_negatives, line_dedup, queries, sharding, token_alignment
from filarium.llm.common import table

DOC = "doc_id long, text string, size int, shard string, v int"
VEC = "vec_id long, label int, embedding array<float>, score string, low int, anchor_id long"


# ---- sharding

def best_fit(sizes, capacity):
    """Plain best fit: the bin of least remaining room that takes the size, the first of equals."""
    rooms, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            i = len(rooms)
            rooms.append(max(capacity, s))
        rooms[i] -= s
        out.append(i)
    return out


def check_shards(rows, docs, shards):
    texts = collections.defaultdict(list)
    for doc_id, text in docs:
        data = (text or "").encode()
        texts[doc_id, len(data) + 1, zlib.crc32(data)].append(text or "")
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == {k: len(v) for k, v in texts.items()}
    by = collections.defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    home = collections.defaultdict(set)
    for r in rows:
        home[r.size, r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in home.values())


def test_bins_are_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randint(1, 400)
        sizes = sorted((rng.randint(1, max(1, capacity * 5 // 4)) for _ in range(rng.randint(0, 300))), reverse=True)
        bins = sharding.Bins(capacity)
        assert [bins.place(s) for s in sizes] == best_fit(sizes, capacity)


def test_rooms_split_and_empty():
    rooms, plain, rng = sharding.Rooms(), [], random.Random(1)
    for i in range(6000):
        if rng.random() < 0.6 and i < 4500:
            rooms.add(room := rng.randint(1, 900), i)
            plain.append((room, i))
        else:
            size = rng.randint(1, 900)
            want = min(((r, n) for r, n in plain if r >= size), default=None)
            assert rooms.take(size) == want
            if want:
                plain.remove(want)


def test_even_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = queries.op11_sharding(spark, sf).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 16)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 16


def test_even_spreads_a_third_and_bundles_again(spark):
    rng = random.Random(2)
    docs = [(i, "copy " * 30 if i % 3 == 0 else "x" * rng.randint(0, 60) + str(i)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check_shards(sharding.shard(df, 4, share=150).collect(), docs, 4)
    groups = sharding.rows_of(df).groupBy("key").agg(F.sum("size").alias("bytes"))
    rows = sharding.even(groups, 4, share=150, fine=64).collect()
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r.bytes
    copies = 1000 * 151
    rest = sum(load.values()) - copies
    assert sorted(load.values())[-1] == copies and max(sorted(load.values())[:3]) <= 1.05 * rest / 3


def test_fixed_capacity(spark):
    rng = random.Random(3)
    items = [(bytes([i % 251, i // 251]), rng.randint(1, 500) if i else 1500) for i in range(4000)]
    df = spark.createDataFrame(items, "key binary, bytes long")
    rows = sharding.fixed(df, 1000, share=700).collect()
    assert collections.Counter(bytes(r.key) for r in rows) == collections.Counter(k for k, _ in items)
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r.bytes
    assert sorted(load.values())[-1] == 1500 and sorted(load.values())[-2] <= 1000
    least = -(-sum(s for _, s in items[1:]) // 1000) + 1
    assert least <= len(load) <= 1.02 * least + 1


def test_shard_odd(spark):
    assert sharding.shard(spark.createDataFrame([], DOC)).collect() == []
    docs = [(1, None), (None, "a"), (None, "a"), (1, "é" * 70_000), (2, ""), (2, ""), (3, "a\x00b"), (3, "a\x00b")]
    df = spark.createDataFrame([(i, t, 9, "s", 1) for i, t in docs], DOC)
    check_shards(sharding.shard(df).collect(), docs, 16)
    one = sharding.shard(df.limit(1)).collect()
    assert [(r.size, r.shard, r.slot, r.text_crc32) for r in one] == [(1, 0, 0, 0)]


# ---- token alignment

@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_links(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    from filarium.llm.bpe import byte_letters

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    byte = {c: i for i, c in enumerate(byte_letters())}

    def links(text):
        """Tokens with their byte ranges, groups and all pairs that overlap."""
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        pairs = [(x, y) for x, e, r in zip(ids_a, ends_a, raw_a) for y, f, s in zip(ids_b, ends_b, raw_b) if max(e - len(r), f - len(s)) < min(e, f)]
        stops, groups, before = sorted(set(ends_a) & set(ends_b)), [], 0
        for stop in stops:
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if before < e <= stop) + "|"
                          + ",".join(str(i) for i, e in zip(ids_b, ends_b) if before < e <= stop))
            before = stop
        return len(ids_a), len(ids_b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()
    return links


def plain_align(docs, links):
    found = [(i, links(t)) for i, t in docs]
    counts = collections.Counter(p for _, x in found if x for p in x[3])
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((str(i), x[0], x[1], x[2], len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4])
                  if x else (str(i), 0, 0, 0, 0, 0, 0, "") for i, x in found), counts


ORDER = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((str(r.doc_id), *tuple(r)[1:]) for r in df.select(*ORDER).collect())


def test_alignment_whole_table(spark, sf, plain_links):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    small = [(i, t) for i, t in docs if len(t or "") < 3000]  # the plain version compares all pairs of tokens
    want, _ = plain_align(small, plain_links)
    df = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    assert got(token_alignment.align(df, queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))) == want
    assert queries.op12_token_alignment(spark, sf).count() == len(docs)


PARTS = ["a", "B", "é", "  ", " ", "\n", "\r", "\t", "　", "\xa0", "'s", "12", ";", "▁", "<s>", "<|endoftext|>", "\x00", "\x1c", "́", "中", "ﬁ", "\x85",
         "}", "){", "word", "don't", "🙂", "‍", "internationalisation", " "]


def test_alignment_odd_texts(spark, paths, plain_links, monkeypatch):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    docs += [(None, None), (None, "null id"), (1, ""), (2, " "), (2, "\n"), (2, "   \n "), (5, "twice"), (5, "twice"), (6, "a▁b"), (7, "<unk><0x41>")]
    want, _ = plain_align(docs, plain_links)
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOC).repartition(4)
    assert got(token_alignment.align(df, *paths)) == want


def test_alignment_small_blocks_and_counts(spark, paths, plain_links):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["token", "alignment", "naïve", "Straße", "x=1", "tokens", "zzzq"]) for _ in range(20))) for i in range(300)]
    want, counts = plain_align(docs, plain_links)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)  # a block for each part
    rows, links = token_alignment.encode_pairs(df, *paths)
    assert got(rows) == want
    assert {(r.a, r.b): r.n for r in links.collect()} == dict(counts)


def test_alignment_blocks_close(paths):
    """Words that come again in a later block are counted there too."""
    aligner = token_alignment.Aligner(*paths)
    vector, pairs = np.zeros(len(aligner.a.bytes), np.int64), collections.Counter()
    for number in range(2):
        block = token_alignment._Block(aligner, number)
        block.texts([1, 2], [token_alignment.words("naïve words"), token_alignment.words("more naïve words")])
        for t in block.close(vector):
            pairs.update({(a, b): n for r, a, b, n in zip(*(t.column(c).to_pylist() for c in (1, 3, 4, 5))) if r == token_alignment.PAIR})
    assert set(pairs.values()) == {4} and vector.max() == 4


def test_alignment_long_and_empty(spark, paths):
    assert token_alignment.align(spark.createDataFrame([], DOC), *paths).collect() == []
    assert got(token_alignment.align(spark.createDataFrame([(1, None, 1, "x", 2)], DOC), *paths)) == [("1", 0, 0, 0, 0, 0, 0, "")]
    texts = ["long words here " * 60_000, "z" * 300_000]
    rows = got(token_alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *paths))
    aligner = token_alignment.Aligner(*paths)
    assert [(r[1], r[2]) for r in rows] == [(len(aligner.a.encode(" " + t)), len(aligner.b.encode(" " + t))) for t in texts]


# ---- earlier operators: rows of one doc_id, vectors of several lengths

def test_rows_of_one_id_lose_only_their_own_lines(spark):
    a, b, c = ("line %s of the text with words enough" % w for w in ("alpha seven", "bravo eleven nights", "charlie under green trees"))
    for one in (None, 3):
        rows = [(one, f"{a}\n{b}"), (one, f"{c}\n{a}"), (9, f"{b}\n{c} tail end of it all")]
        got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        lines = sorted(x for r in got for x in r.text.split("\n"))
        assert lines.count(a) == 1 and {a, b, c} <= set(lines) and lines.count(b) == 1
    twice = spark.createDataFrame([(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(twice).collect()) == [(1, f"{a}\n{b}")] * 2


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=(2, 3, 7)[i % 3])]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id < 9"), k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    wide = {i: np.array(v + [0.0] * (7 - len(v))) for i, v in rows}
    for q in range(9):
        near = sorted((-float(wide[q] @ v), i) for i, v in wide.items() if i != q)
        assert [x[2] for x in sorted(got[q])][0] == round(-near[0][0], 9) and len(got[q]) == 4


# ---- hard negatives

def plain_mine(rows, every, positives=5, negatives=10, low=30, high=90):
    best = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in best.items() if i != a and len(v) == len(q))
        for s, p in [(s, i) for s, i, other in near if other == label][:positives]:
            hard = [(n, i) for n, i, other in near if other != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(hard, 1)]
    return sorted(out)


def mined(df, every, **kw):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect()))


@pytest.mark.parametrize("first", [1, 4, 64])
def test_negatives_against_all_pairs(spark, first):
    rng = np.random.default_rng(first)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=6)], "s", 1, 2) for i in range(900)]
    same = [0.5, 0.25, 0.5, 0.0, 0.5, 0.5]
    rows += [(1000 + i, i % 3, same, "s", 1, 2) for i in range(450)]  # a third of all rows with one vector
    assert mined(spark.createDataFrame(rows, VEC).repartition(3), 50, first=first) == plain_mine(rows, 50)


def test_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives.best_in_windows, "__defaults__", (4, 100))
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 2)), [float(x) for x in rng.integers(-3, 4, size=3)], "s", 1, 2) for i in range(700)]
    assert mined(spark.createDataFrame(rows, VEC), 20, n_positives=7, n_negatives=3, low=10, high=100, first=2) == plain_mine(rows, 20, 7, 3, 10, 100)


def test_negatives_odd(spark):
    assert mined(spark.createDataFrame([], VEC), 10) == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (2, 2, [0.5, 0.0]), (2, 3, [9.0, 9.0]), (3, None, [1.0, 1.0]), (4, 2, None),
            (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (8, 2, [0.5]), (9, 2, [0.5, 0.0, 0.0]), (10, 4, []),
            (20, 4, []), (30, 5, []), (40, 6, [0.0, 0.0]), (41, 6, [0.0, 0.0]), (42, 2, [0.0, 0.0]), (50, 7, [-1.0, 2.0]), (51, 7, [2.0, 0.5]), (60, 8, [5.0, 5.0])]
    rows = [(*r, "s", 1, 2) for r in rows]
    got_ = mined(spark.createDataFrame(rows, VEC), 10)
    assert got_ == plain_mine(rows, 10) and any(r[4] == 0 for r in got_)
    huge = [(0, 1, [3e38, 1.0], "s", 1, 2), (1, 1, [3e38, 1.0], "s", 1, 2), (2, 2, [1.0, 1.0], "s", 1, 2)]
    assert mined(spark.createDataFrame(huge, VEC), 10) == []


def test_negatives_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = queries.op13_hard_negatives(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(queries.SQL["op13_hard_negatives"]).select(*df.columns).fetchall())
