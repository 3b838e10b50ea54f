"""Query interpretation, search, project grouping, review and streams."""

import collections
import random
import shutil
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from filarium import constants as K
from filarium.operators import lookup as L, nlquery as N, projects as P, reports as R, review as RV, search as S
from filarium.streaming import streams as ST

NOW = datetime(2025, 7, 15, 10, 30)
MB = 1024 ** 2
D = datetime
QUERIES = {
    "files larger than 500 MB": {"min_size_bytes": 500 * MB},
    "files over 2 GB": {"min_size_bytes": 2 * 1024 * MB},
    "over 500 KB": {"min_size_bytes": 500 * 1024},
    "larger than 1,250.5 kb": {"min_size_bytes": 1280512},
    "bigger than 2 t": {"min_size_bytes": 2 * 1024 ** 4},
    "files smaller than 10 MB": {"max_size_bytes": 10 * MB},
    "photos under 1 GB": {"max_size_bytes": 1024 * MB, "categories": ["Photography"]},
    "show me all PDFs": {"extensions": ["pdf"]},
    "spreadsheets from 2019": {"extensions": ["xlsx", "xls", "csv"], "date_label": "2019"},
    "photos from last week": {"date_from": D(2025, 7, 7), "date_to": D(2025, 7, 13, 23, 59, 59, 999000)},
    "files from this month": {"date_from": D(2025, 7, 1), "date_to": D(2025, 7, 15, 23, 59, 59, 999000)},
    "invoices from last month": {"date_from": D(2025, 6, 1), "date_to": D(2025, 6, 30, 23, 59, 59, 999000)},
    "invoices from December": {"date_from": D(2024, 12, 1), "date_label": "December 2024"},
    "contracts from 2024": {"date_from": D(2024, 1, 1), "categories": ["Legal"]},
    "tax documents from last year": {"date_label": "2024"},
    "yesterday": {"date_from": D(2025, 7, 14)},
    "large photos": {"date_from": None, "min_size_bytes": 100 * MB},
    "huge large files over 5 mb": {"min_size_bytes": 5 * MB},
    "documents mentioning Ingrid": {"mentioned_entity": "Ingrid"},
    "files related to Alpha Hair": {"mentioned_entity": "Alpha Hair"},
    "documents regarding Kennards from 2020": {"mentioned_entity": "Kennards"},
    "xz9-random-string": {"confidence": 0.0, "categories": [], "unrecognized_terms": ["xz9-random-string"]},
    "duplicate installers larger than 500 MB": {"statuses": ["duplicate"], "min_size_bytes": 500 * MB},
    "banking statements from 2025 mentioning Kennards": {"categories": ["Banking"], "mentioned_entity": "Kennards"},
    "screenshots from last week safe to delete": {"statuses": ["safe_delete"], "categories": ["Screenshots"]},
}


def test_interpretation(spark):
    df = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    for r in N.interpret_queries(df, NOW).collect():
        for field, expected in QUERIES[r["query"]].items():
            assert r[field] == expected, (r["query"], field, r[field])
    r = N.interpret_queries(df.filter("query = 'photos under 1 GB'"), NOW).first()
    assert [tuple(c) for c in r.applied_filters] == [("Category", "Photography", "category"), ("Max size", "≤ 1.0 GB", "size")]
    assert r.explanation.startswith('Interpreted as: category "Photography", size ≤ 1.0 GB.')


def finding(i, name, path=None, **kw):
    row = {"finding_id": i, "scan_id": 1, "type": "none", "path": path or f"/Users/test/Documents/{name}", "name": name,
           "extension": ".pdf", "size_bytes": MB, "risk_level": "low", "modified_at": NOW, "created_at": NOW + timedelta(seconds=i),
           "ai_category": "Invoices", "ai_confidence": 95}
    return {**row, **kw}


@pytest.fixture(scope="module")
def found(spark):
    rows = [finding(1, "invoice-2024.pdf"), finding(2, "invoice"), finding(3, "my invoice 2.pdf"),
            finding(4, "other.pdf", "/x/invoice/other.pdf"), finding(5, "clip.mov", extension=".mov", ai_category="Video", ai_confidence=50, size_bytes=900 * MB),
            finding(6, "100%_done.txt", extension="txt", ai_category=None, ai_confidence=None, type="duplicate")]
    return spark.createDataFrame(rows)


def side(spark):
    return (spark.createDataFrame([(1, "invoices"), (5, "video")], "finding_id long, tag string"),
            spark.createDataFrame([(3, "organization", "Alpha Hair Pty")], "finding_id long, type string, value string"))


def test_scores(spark, found):
    s = {r.finding_id: r for r in S.score_findings(found, "invoice", {}).collect()}
    assert s[2].relevance_score > s[1].relevance_score > s[4].relevance_score
    assert all(0 <= r.relevance_score <= 1 for r in s.values())
    assert s[6].relevance_score == 0.01 and s[6].match_explanation == "Matched by applied filter."
    assert s[2].matched_factors[0] == 'exact filename match "invoice"'
    assert s[1].match_explanation.endswith('File is classified as "Invoices" (95% confidence).')


def test_search_scores_before_paging(spark, found):
    tags, ents = side(spark)
    page, total = S.search(found, tags, ents, "invoice", NOW, limit=1, ai_category="")
    assert (page.first().finding_id, total.first().total) == (2, 5 - 1)
    big, _ = S.search(found, tags, ents, "videos over 500 mb", NOW)
    assert [r.finding_id for r in big.collect()] == [5]
    named, _ = S.search(found, tags, ents, "files related to Alpha Hair", NOW)
    assert [r.finding_id for r in named.collect()] == [3]
    plain, _ = S.search(found, tags, ents, "clip.mov", NOW, category="", ai_category="")
    assert [r.finding_id for r in plain.collect()] == [5]


def test_explicit_filters_win_and_bad_dates_are_ignored(spark, found):
    tags, ents = side(spark)
    guess = S.interpret_one(spark, "large duplicate videos", NOW)
    f = S.resolve_filters({"min_size_bytes": 1}, guess)
    assert (f["category"], f["duplicates_only"], f["min_size_bytes"], f["tags"]) == ("Video", True, 1, [])
    assert S.resolve_filters({}, guess, strict=True)["tags"] == ["video", "duplicate-candidates"]
    assert S.apply_filters(found, tags, ents, {"date_from": "not a date"}).count() == 6
    assert S.apply_filters(found, tags, ents, {"extension": "pdf"}).count() == 4
    assert S.list_findings(found, search="100%_").count() == 1
    assert S.list_findings(found, search="i%e-2").count() == 1  # wildcards stay live


def test_batch_equals_single_searches(spark, found):
    tags, ents = side(spark)
    qs = ["invoices over 500 kb", "PDFs", "duplicates", "files related to Alpha Hair", "other", "100%_d", "videos from this week", "files under 2 mb"]
    table = N.interpret_queries(spark.createDataFrame(list(enumerate(qs)), "query_id long, query string"), NOW)
    got = {}
    for r in S.batch_search(table, found, ents).collect():
        got.setdefault(r.query_id, []).append((r.position, r.finding_id, r.relevance_score))
    for i, q in enumerate(qs):
        page, _ = S.search(found, tags, ents, q, NOW)
        assert [x[1:] for x in sorted(got.get(i, []))] == [(r.finding_id, r.relevance_score) for r in page.collect()], q


def test_alike_queries_are_asked_once(spark, found, monkeypatch):
    _, ents = side(spark)
    qs = ["invoices over 500 kb", "PDFs", "files related to Alpha Hair"] * 40
    table = N.interpret_queries(spark.createDataFrame(list(enumerate(qs)), "query_id long, query string"), NOW)
    met, plain = [], S.meet
    monkeypatch.setattr(S, "meet", lambda rows, offered, asked, row_id: met.append(asked.count()) or plain(rows, offered, asked, row_id))
    pairs, pages = (collections.Counter((r.query_id, r.finding_id) for r in f(table, found, ents).collect()) for f in (S.batch_matches, S.batch_search))
    assert max(met) <= 10 and pairs == pages and set(pairs.values()) == {1}
    totals = {r.query_id: r.total for r in S.batch_totals(table, found, ents).collect()}
    for i, q in enumerate(qs):
        mine = {f for n, f in pairs if n == i}
        assert mine == {f for n, f in pairs if n == i % 3} and totals[i] == len(mine) > 0, q


def test_batch_by_every_access_path_without_broadcast(spark):
    rng = random.Random(5)
    names = ["invoice", "clip", "a", "b_1", "100%", "Résumé", "plan"]
    rows = [finding(i, f"{rng.choice(names)}-{i}.{rng.choice(['pdf', 'mov', 'txt'])}", extension=rng.choice([".pdf", ".mov", "txt", ""]),
                    ai_category=rng.choice(["Invoices", "Video", None]), type=rng.choice(["duplicate", "installer", "none"]),
                    size_bytes=rng.choice([0, 1, 5, 10, 800]) * MB, modified_at=NOW - timedelta(days=rng.randint(0, 900), hours=rng.randint(0, 23)))
            for i in range(1, 300)]
    found = spark.createDataFrame(rows)
    tags, _ = side(spark)
    ents = spark.createDataFrame([(i, "organization", f"{'Zed' if i % 3 else 'Alpha Hair'} {i % 7} Q") for i in range(1, 300)],
                                 "finding_id long, type string, value string")
    qs = ["", "  ", "a", "b_1", "%", "_", "0%", "ré", "plan-2", "zzzz", "over 5 mb", "under 2 mb", "from this week", "from last month", "over 1 mb from 2023",
          "invoices from 2023", "invoice pdfs", "pdfs over 1 mb", "duplicates", "installers", "files related to Alpha Hair", "files related to Q", "large files"]
    table = N.interpret_queries(spark.createDataFrame(list(enumerate(qs)), "query_id long, query string"), NOW)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = collections.defaultdict(list)
        for r in S.batch_matches(table, found, ents).select("query_id", "finding_id").collect():
            got[r.query_id].append(r.finding_id)
        totals = {r.query_id: r.total for r in S.batch_totals(table, found, ents).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    paths = {r._path for r in S._paths(S.resolved_queries(table)).collect()}
    assert paths == {"all", "text", "keys", "days", "sizes", "name"}
    for i, q in enumerate(qs):
        f = S.resolve_filters({}, S.interpret_one(spark, q, NOW) if q.strip() else None)
        want = S.apply_filters(found, tags, ents, f, S.plain_text_fallback(q, f))
        assert sorted(got[i]) == sorted(r.finding_id for r in want.select("finding_id").collect()), q
        assert totals[i] == len(got[i])


def test_day_ranges_are_cut_exactly(spark):
    rng = random.Random(9)
    spans = [(None, None), ("0001-01-01", "0001-01-01"), ("1969-12-30", "1970-01-02")]
    for _ in range(60):
        a = date(1900, 1, 1) + timedelta(days=rng.randint(0, 70000))
        spans.append((str(a), str(a + timedelta(days=rng.choice([-1, 0, 3, 15, 16, 40, 300, 5000])))))
    spans += [("1999-05-05", None), (None, "1999-05-05")]
    days = [str(date(1890, 1, 1) + timedelta(days=rng.randint(0, 80000))) for _ in range(200)] + [d for s in spans for d in s if d]
    q = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, a string, b string")
    q = q.select("i", L.day_range_keys(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("k"))
    d = spark.createDataFrame([(x,) for x in set(days)], "d string").select("d", L.day_keys(F.col("d").cast("timestamp")).alias("k"))
    asked = {r.i: r.k for r in q.collect()}
    assert all(len(k) <= 150 and len(set(k)) == len(k) for k in asked.values())
    for r in d.collect():
        for i, (a, b) in enumerate(spans):
            shared = len(set(r.k) & set(asked[i]))
            assert shared == int((a is None or r.d >= a) and (b is None or r.d <= b)), (r.d, a, b)


# ---- projects ------------------------------------------------------------------------

def random_findings(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        path = "/" + "/".join([rng.choice("ab"), rng.choice("abc"), rng.choice("abcdef"), rng.choice("abcdefgh")][:rng.randrange(1, 5)])
        name = f"{rng.choice(['doc', 'invoice', 'x'])}_{rng.randrange(9)}-{i % 4}.pdf"
        vec = [rng.random() for _ in range(3)] if rng.random() < .7 else None
        out.append((i, rng.randrange(2), f"{path}/{name}", name, NOW - timedelta(days=rng.randrange(120)) if rng.random() < .9 else None, 10,
                    rng.choice(["Legal", "Tax", "", None]), rng.sample(["t1", "t2", "t3", "document"], rng.randrange(3)),
                    [f"e{rng.randrange(12)}"] if rng.random() < .6 else [], vec))
    return out


SCHEMA = ("finding_id long, scan_id long, path string, name string, modified_at timestamp, size_bytes long, ai_category string, "
          "tags array<string>, entities array<string>, vector array<float>")


def all_pairs(spark, aug, approved, rejected, per_scan):
    """Links of all pairs by the column form of the signals."""
    a = aug.select(F.col("finding_id").alias("i"), "scan_id", F.struct("*").alias("a"))
    b = aug.select(F.col("finding_id").alias("j"), "scan_id", F.struct("*").alias("b"))
    pairs = a.join(b, "scan_id") if per_scan else a.drop("scan_id").crossJoin(b.drop("scan_id"))
    rows = P.score_pairs(pairs.filter("i < j")).select("i", "j", "score", "signals").collect()

    def together(groups, i, j):
        return any(i in g and j in g for g in groups)

    return [r for r in rows if not together(approved, r.i, r.j)
            and r.score >= K.LINK_THRESHOLD + (K.REJECTED_EXTRA if together(rejected, r.i, r.j) else 0)]


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("tile_rows, per_scan", [(512, True), (7, True), (7, False), (512, False)])
def test_links_and_components_equal_all_pairs(spark, tile_rows, per_scan):
    aug = spark.createDataFrame(random_findings(90, 5), SCHEMA)
    approved, rejected = [set(range(0, 90, 9))], [set(range(1, 90, 4)), {2, 3, 5}]

    def table(groups):
        return spark.createDataFrame([(g, i) for g, s in enumerate(groups) for i in s], "group_id long, finding_id long")

    links = all_pairs(spark, aug, approved, rejected, per_scan)
    groups = P.link_groups(aug, table(approved), table(rejected), per_scan=per_scan, tile_rows=tile_rows).cache()
    total = groups.agg(F.sum("links").alias("n"), *[F.sum(s).alias(s) for s in P.SIGNALS]).first()
    assert total.n == len(links) > 0
    for s in P.SIGNALS:
        assert abs(total[s] - sum(r.signals[s] for r in links)) < 1e-6
    comps = {r.node: r.component for r in P.components(groups).collect()}
    assert comps == union_find([(r.i, r.j) for r in links])


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 800)] + [(1, 2), (2, 3), (3, 1), (9, 9)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "id long, rep long")
    got = {r.node: r.component for r in P.components(df).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])
    assert P.components(df.limit(0)).count() == 0


def test_candidates_are_named_and_explained(spark):
    rows = [(1, 1, "/projects/acme/brand/logo.svg", "logo.svg", NOW, 5, "Branding"), (2, 1, "/projects/acme/brand/logo-v2.svg", "logo-v2.svg", NOW, 7, "Branding"),
            (3, 1, "/home/z/unrelated.txt", "unrelated.txt", None, 9, "Legal")]
    f = spark.createDataFrame(rows, "finding_id long, scan_id long, path string, name string, modified_at timestamp, size_bytes long, ai_category string")
    tags = spark.createDataFrame([(1, "Logo"), (2, "logo")], "finding_id long, tag string")
    none = spark.createDataFrame([], "finding_id long, value string")
    chunks = spark.createDataFrame([], "finding_id long, chunk_index int, vector array<float>")
    rows, members = P.generate_candidates(f, tags, none, chunks)
    [c] = rows.collect()
    assert (c.name, c.file_count, c.link_count) == ("Project: projects", 2, 1)
    assert c.explanation == "Files share a common folder and 4 other signals"
    assert sorted(r.finding_id for r in members.collect()) == [1, 2]


def test_decisions_and_split(spark):
    cands = spark.createDataFrame([(1, "A", .4, "x", "pending"), (2, "B", .6, "y", "pending"), (3, "C", .5, "z", "rejected")],
                                  "candidate_id long, name string, score double, explanation string, status string")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12)], "candidate_id long, finding_id long")
    decisions = spark.createDataFrame([(100, "merge", 1), (100, "merge", 2), (101, "approve", 3), (102, "reject", 77), (103, "merge", 3)],
                                      "decision_id long, action string, candidate_id long")
    done, projects, links, errors = P.apply_project_decisions(cands, members, decisions)
    assert {r.candidate_id: (r.status, r.project_id) for r in done.collect()} == {1: ("merged", 100), 2: ("merged", 100), 3: ("rejected", None)}
    [p] = projects.collect()
    assert (p.project_id, p.name, round(p.confidence, 6), p.explanation) == (100, "A", .5, "Merged from 2 candidates.")
    assert sorted(r.finding_id for r in links.collect()) == [10, 11]
    assert {r.decision_id: r.error for r in errors.collect()} == {101: "candidate is not pending", 102: "candidate not found", 103: "candidate is not pending"}
    moves = spark.createDataFrame([(100, 11, 200, "New")], "project_id long, finding_id long, new_project_id long, new_name string")
    made, all_links = P.split_project(projects, links, moves)
    assert made.first().explanation == 'Split from project "A"'
    assert sorted((r.project_id, r.finding_id) for r in all_links.collect()) == [(100, 10), (200, 11)]


# ---- review and reports -------------------------------------------------------------------

def test_audit_of_a_busy_finding_equals_a_plain_walk(spark):
    rng = random.Random(2)
    ev = [(i, 1 if i % 3 == 0 else rng.randrange(2, 9), rng.choice(list(K.REVIEW_ACTIONS)), NOW + timedelta(minutes=rng.randrange(3000))) for i in range(400)]
    df = spark.createDataFrame(ev, "event_id long, finding_id long, action string, ts timestamp")
    expected, state = {}, {}
    for i, f, a, t in sorted(ev, key=lambda e: (e[3], e[0])):
        expected[i] = (state.get(f, "new"), K.REVIEW_ACTIONS[a])
        state[f] = K.REVIEW_ACTIONS[a]
    for width in (60, 3600, 10 ** 9):
        got = {r.event_id: (r.previous_status, r.new_status) for r in RV.review_audit(df, width).collect()}
        assert got == expected
    findings = spark.createDataFrame([(i,) for i in range(1, 11)], "finding_id long")
    assert {r.finding_id: r.review_status for r in RV.fold_reviews(findings, df).collect()} == {i: state.get(i, "new") for i in range(1, 11)}


def test_ignore_and_unignore(spark):
    f = spark.createDataFrame([(1, "duplicate", "duplicate"), (2, "zero_byte", "safe_delete"), (3, "archive", "review")], "finding_id long, type string, finding_status string")
    ev = spark.createDataFrame([(1, 1, "ignore", NOW), (2, 1, "unignore", NOW + timedelta(1)), (3, 2, "ignore", NOW), (4, 2, "unignore", NOW + timedelta(1)), (5, 3, "ignore", NOW)],
                               "event_id long, finding_id long, action string, ts timestamp")
    assert {r.finding_id: r.finding_status for r in RV.fold_ignores(f, ev).collect()} == {1: "duplicate", 2: "review", 3: "ignored"}


def test_empty_reports(spark):
    files = spark.createDataFrame([], "status string, size_bytes long, tags array<string>, category string, extension string")
    assert tuple(R.file_counts(files).first()) == (0, 0, 0, 0.0)
    assert R.file_stats(files).first().total_size_bytes == 0


# ---- streams --------------------------------------------------------------------------------

ENTRY = "scan_id long, path string, name string, extension string, size_bytes long, modified_at timestamp, is_dir boolean, hash string"


def entry_stream(spark, tmp_path, rows, files=3):
    src = str(tmp_path / "src")
    for i in range(files):
        spark.createDataFrame(rows[i::files], ENTRY).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(src), spark.read.schema(ENTRY).parquet(src)


def entries():
    return [(1, f"/d/{i}.{e}", f"{i}.{e}", f".{e}", 0 if i % 5 == 0 else 10, NOW - timedelta(days=i), False, f"h{i % 4}")
            for i, e in enumerate(["txt", "zip", "dmg", "pdf", "idlk"] * 6)]


def latest_rows(spark, stream, name, tmp_path, key):
    """Run an update-mode stream to its end and keep the last row per key."""
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[tuple(r[k] for k in key)] = r.asDict()

    q = (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return seen


def test_stream_findings_equals_batch(spark, tmp_path):
    stream, batch = entry_stream(spark, tmp_path, entries())
    for _ in range(2):  # a second run finds nothing new
        ST.append_scan(ST.stream_findings(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("path", "type", "ai.category").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, ST.stream_findings(batch).select("path", "type", "ai.category").collect()))


def test_stream_duplicates_and_progress_equal_batch(spark, tmp_path):
    stream, batch = entry_stream(spark, tmp_path, entries())
    got = latest_rows(spark, ST.stream_duplicates(stream), "dup", tmp_path, ["hash"])
    assert sorted(map(str, got.values())) == sorted(str(r.asDict()) for r in ST.stream_duplicates(batch).collect())
    got = latest_rows(spark, ST.scan_progress(stream), "pro", tmp_path, ["scan_id"])
    assert got[(1,)] == ST.scan_progress(batch).first().asDict()
    assert [r[0] for r in spark.range(1).select(ST.progress_percent(F.lit(1), F.lit(5), F.lit(10))).collect()] == [92]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(NOW + timedelta(minutes=7 * i), "click" if i % 2 else "view") for i in range(60)]
    src = str(tmp_path / "ev")
    schema = "ts timestamp, event_type string"
    for i in range(2):
        spark.createDataFrame(rows[i * 30:(i + 1) * 30], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = latest_rows(spark, ST.activity_windows(stream, "1 hour", "2 hours"), "win", tmp_path, ["window_start", "event_type"])
    assert sorted(map(str, got.values())) == sorted(str(r.asDict()) for r in ST.activity_windows(spark.read.parquet(src), "1 hour").collect())


def test_duplicates_with_state_that_expires(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "path string, size_bytes long, hash string, modified_at timestamp, seen_at timestamp"
    hours = [[("/a", "h1", 0, t0), ("/b", "h2", 0, None), ("/z", "h3", 0, t0)], [("/c", "h1", 1, t0 - timedelta(days=1)), ("/y", "h3", 1, None), ("/x", "h3", 1, t0)],
             [("/d", "h4", 9, t0)], [("/e", "h2", 10, t0), ("/f", "h1", 10, t0)], [("/g", "h2", 11, t0)]]
    src = str(tmp_path / "src")
    for part in hours:
        rows = [(p, 10, h, m, t0 + timedelta(hours=at)) for p, h, at, m in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    q = (ST.recent_duplicates(stream, "3 hours").writeStream.outputMode("update").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "short")).foreachBatch(lambda b, _: seen.extend(map(tuple, b.drop("last_seen").collect()))).start())
    q.awaitTermination()
    # of h1 and h2 the state was gone when more copies came at 10; h2 met its next copy at 11
    assert sorted(seen) == [(10, "h1", 2, "/c"), (10, "h2", 2, "/e"), (10, "h3", 3, "/x")]
    state = max((p.stateOperators[0].numRowsTotal for p in [q.lastProgress]), default=0)
    assert state <= 3
    held = latest_rows(spark, ST.recent_duplicates(stream, "30 days").drop("last_seen"), "long", tmp_path, ["hash"])
    batch = {(r.hash,): (r.copies, r.canonical_path) for r in ST.stream_duplicates(spark.read.parquet(src)).collect()}
    assert {k: (v["copies"], v["canonical_path"]) for k, v in held.items()} == batch and len(batch) == 3


def test_progress_of_the_hashing_phase(spark, tmp_path):
    stream, batch = entry_stream(spark, tmp_path, entries())
    events = "scan_id long, to_hash long, path string"
    rows = [(1, 8, None), *[(1, None, f"/d/{i}") for i in range(6)], (2, 0, None)]
    src = str(tmp_path / "hashing")
    spark.createDataFrame(rows, events).coalesce(1).write.parquet(src)
    hashing = spark.readStream.schema(events).parquet(src)
    got = latest_rows(spark, ST.scan_progress(stream, hashing), "progress2", tmp_path, ["scan_id"])
    want = {(r.scan_id,): r.asDict() for r in ST.scan_progress(batch, spark.read.parquet(src)).collect()}
    assert got == want
    assert (got[1,]["progress_percent"], got[1,]["files_hashed"], got[1,]["files_to_hash"], got[1,]["files_scanned"]) == (85 + 11, 6, 8, 30)
    assert got[2,]["progress_percent"] == 99 and got[2,]["files_scanned"] == 0
    alone = ST.scan_progress(batch).first()
    assert alone.progress_percent < 85 and "files_hashed" not in alone.asDict()


def test_pages_read_only_their_blocks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50)) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, score int").repartition(7)
    order = [F.desc("score"), F.asc("id")]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.score) for r in S.numbered(df, order).orderBy("row_number").collect()] == want
    out = str(tmp_path / "pages")
    S.write_pages(df, order, out, block=100)
    for block in range(26):  # a page needs none of the others
        if block not in (19, 20):
            shutil.rmtree(f"{out}/rows/block={block}", ignore_errors=True)
    page, total = S.read_page(spark, out, 60, 1970)
    assert total == 2500 and [(r.id, r.score) for r in page.collect()] == want[1970:2030]
    S.write_pages(df.limit(0), order, out)
    assert S.read_page(spark, out, 5)[1] == 0 and R.share_of(df, "score").agg(F.sum("share")).first()[0] > 0.999


def test_facets_are_dealt_out_before_they_are_told_apart(spark):
    from filarium.operators import projects as PR
    members = spark.createDataFrame([(1, 10, "Legal"), (1, 11, "Legal"), (2, 10, ""), (2, 12, None)], "project_id long, finding_id long, ai_category string")
    ents = spark.createDataFrame([(10, "person", "Ann"), (11, "person", "Ann"), (12, "organization", "Acme"), (12, "place", "Rome"), (10, "person", "")],
                                 "finding_id long, type string, value string")
    out = PR.project_facets(members, ents)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "category", "Legal"), (1, "person", "Ann"), (2, "organization", "Acme"), (2, "person", "Ann")]
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()


def tile_rows_of(n, side=None):
    import numpy as np
    import pandas as pd
    rng = random.Random(n)
    rows = []
    for i in range(n):
        folder = [rng.randrange(5), 10 + rng.randrange(20)]
        rows.append((i, np.array([folder[0], 100 * folder[0] + folder[1], 10**6 + i]), np.array(rng.sample(range(8), rng.randrange(1, 4))),
                     np.array(rng.sample(range(30), rng.randrange(2))), np.array([rng.randrange(9), 10**6 + i]), rng.randrange(6), True, i * 3_600_000,
                     np.array([rng.random() for _ in range(4)], "f4") if i % 3 == 0 else None, np.array([i // 9][:i % 2]), np.array([i // 7][:i % 2]),
                     np.array([1, 5, 9 + i % 3]), 5, 0, 0 if side is None else 1, 0 if side is None else side(i)))
    return pd.DataFrame(rows, columns="id prefixes tags ents toks cat has_cat ms vector approved rejected keys key lo hi side".split())


@pytest.mark.parametrize("side", [None, lambda i: i % 5 // 3])
def test_tile_in_pieces(monkeypatch, side):
    rows = tile_rows_of(300, side).assign(key=1)  # no pair counts in an earlier block
    want = sorted(P._score_tiles(rows))
    assert sum(r[2] for r in want) > 100
    monkeypatch.setattr(P, "CHUNK", 37)
    got = sorted(P._score_tiles(rows))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(x - y) < 1e-6 for a, b in zip(got, want) for x, y in zip(a[3:], b[3:]))
    assert sum(r[2] for r in P._score_tiles(rows.assign(key=5))) == 0  # all share key 1, which is smaller


def test_large_tile_takes_bounded_memory():
    import tracemalloc
    rows = tile_rows_of(3000)
    tracemalloc.start()
    P._score_tiles(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def test_tiles_of_large_blocks_run_in_rounds(spark, monkeypatch):
    """No round holds more than twice the rows of all blocks, and the rounds have each tile of a block once."""
    aug = spark.createDataFrame(random_findings(90, 5), SCHEMA)
    whole, seen = P._linked, []
    monkeypatch.setattr(P, "_linked", lambda tiles: seen.append(tiles.select("id", "key", "lo", "hi").collect()) or whole(tiles))
    P.link_groups(aug, tile_rows=7).count()
    rows = [tuple(r) for tiles in seen for r in tiles]
    sides = {}
    for _, key, _, hi in rows:
        sides[key] = max(sides.get(key, 0), hi + 1)
    members = {(i, key) for i, key, _, _ in rows}
    assert len(seen) > 2 and max(map(len, seen)) <= 2 * len(members) and max(sides.values()) > 4
    assert len(rows) == len(set(rows)) == sum(sides[key] for _, key in members)
    assert P._rounds({}) == [(0, 0)] and P._rounds({1: 9, 2: 3}) == [(0, 1)] and P._rounds({5: 9}) == [(0, 0), (1, 1), (2, 2)]


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    import pathlib

    from filarium.session import cut_lineage
    held = lambda: sum(f.stat().st_size for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
                       for f in pathlib.Path(d.getPath()).rglob("shuffle_*"))
    at = held()
    back = cut_lineage(spark.range(200_000).repartition(4, "id").groupBy("id").count())
    assert held() <= at and back.count() == 200_000


def best_by_hand(ids, queries, findings, chunks, vectors, k, least):
    import numpy as np
    scores = np.round(vectors @ queries.T, 9)
    out = []
    for q, i in enumerate(ids):
        best = {}
        for row in np.argsort(chunks, kind="stable"):
            s = scores[row, q]
            if s >= least and s > best.get(findings[row], (-1e99,))[0]:
                best[findings[row]] = (s, chunks[row])
        ranked = sorted(((-s, f, c) for f, (s, c) in best.items()))[:k]
        out += [(i, int(f), int(c), round(float(-s), 7)) for s, f, c in ranked]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 1e-3, 1e6, 1e200])
@pytest.mark.parametrize("k", [5, None])
def test_few_scores_are_worked_out_in_full(monkeypatch, k, size):
    """Only pairs that single precision does not rule out are scored in full; ties and equal texts come out as before."""
    import numpy as np
    from filarium.operators import vectors as V
    rng = np.random.default_rng(7)
    findings = np.sort(rng.integers(0, 900, 3000))
    chunks, ids = np.arange(3000), np.arange(100, 130)
    vectors, queries = np.round(rng.random((3000, 16)), 1) * size, np.round(rng.random((30, 16)), 1)
    vectors[1500:1600] = vectors[100:200]
    queries[3] = 0
    least = float(size * np.quantile(vectors / size @ queries.T, 0.99))
    looked, near = [], V._Top._near
    monkeypatch.setattr(V._Top, "_near", lambda self, v: looked.append(near(self, v)) or looked[-1])
    monkeypatch.setattr(V, "SCORES", 30 * 250)
    top = V._Top(ids, queries, k, least)
    parts = [*top.add(findings[:1700], chunks[:1700], vectors[:1700]), *top.add(findings[1700:], chunks[1700:], vectors[1700:]), *top.rows()]
    got = [r for b in parts for r in zip(*(c.to_pylist() for c in b.columns))]
    want = best_by_hand(ids, queries, findings, chunks, vectors, k, least)
    if k is None:  # the chunks of a finding may lie in two tiles
        best = {}
        for q, f, c, s in got:
            best[q, f] = max(best.get((q, f), (-1e99, 0)), (s, -c))
        got = [(q, f, -c, s) for (q, f), (s, c) in best.items()]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want] and len(want) > 30
    assert all(abs(a[3] - b[3]) <= 1e-6 * size for a, b in zip(sorted(got), want))
    if size < 1e15:
        assert sum(len(row) for row, _ in looked if row is not None) < 0.05 * vectors.shape[0] * len(ids)
        assert sum(row is None for row, _ in looked) <= 1
    else:
        assert all(row is None for row, _ in looked)
