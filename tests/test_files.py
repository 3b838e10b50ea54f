"""Findings, duplicates, classification, paths and extraction on small inputs."""

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from filarium import constants as K
from filarium.operators import classify as C, dedup as D, findings as FN, paths as P, skew
from filarium.sources import files as S

FILE = "scan_id long, path string, name string, extension string, size_bytes long, modified_at timestamp, content string, is_dir boolean"


def files(spark, rows):
    made = []
    for path, content, *at in rows:
        name = path.rsplit("/", 1)[-1]
        ext = "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
        made.append((1, path, name, ext, len(content), at[0] if at else None, content, False))
    return spark.createDataFrame(made, FILE)


def test_identical_files_form_one_group(spark):
    same = "x" * 38
    f = files(spark, [("/d/a.txt", same), ("/d/b.txt", same), ("/d/c.txt", "other")])
    [g] = D.duplicate_report(f).collect()
    assert (g.file_count, g.total_size_bytes, g.wasted_bytes, g.extension_count) == (2, 76, 38, 1)
    assert g.explanation == "2 files share identical SHA-256 content (.txt)"


def test_same_size_other_content_is_a_bucket_but_no_group(spark):
    f = files(spark, [("/a/n.txt", "aaaaaaaaaa"), ("/b/n.txt", "bbbbbbbbbb"), ("/c/empty", ""), ("/d/empty", "")])
    assert D.stage_candidates(f).count() == 2
    assert D.duplicate_report(f).count() == 0


def test_split_threshold_misses_equal_content_under_a_lone_extension(spark):
    f = files(spark, [("/a.txt", "aa"), ("/b.txt", "bb"), ("/c.pdf", "aa")])
    exact = D.duplicate_groups(D.hash_contents(D.stage_candidates(f)))
    split = D.duplicate_groups(D.hash_contents(D.stage_candidates(f, split_threshold=2)))
    assert (exact.count(), split.count()) == (1, 0)
    assert "across 2 extensions" in exact.first().explanation


def test_canonical_is_oldest_then_smallest_path(spark):
    old, new = datetime(2020, 1, 1), datetime(2024, 1, 1)
    f = files(spark, [("/z/old.txt", "one", old), ("/a/new.txt", "one", new), ("/b/none.txt", "one"),
                      ("/b/tie.txt", "two", new), ("/a/tie.txt", "two", new)])
    got = {r.file_count: r.canonical_path for r in D.duplicate_report(f).collect()}
    assert got == {3: "/z/old.txt", 2: "/a/tie.txt"}


def cache_of(spark, rows):
    return spark.createDataFrame(rows, "path string, size_bytes long, modified_at timestamp, hash string, algo string")


def test_only_files_the_cache_misses_are_opened(spark, tmp_path):
    at, later = datetime(2024, 1, 1), datetime(2024, 2, 2)
    big = b"0123456789abcdef" * 300_000
    for name, data in (("miss é.bin", big), ("moved.txt", b"new text"), ("grown.txt", b"more")):
        (tmp_path / name).write_bytes(data)
    p = str(tmp_path)
    rows = [(f"{p}/hit.txt", 5, at), (f"{p}/miss é.bin", len(big), at), (f"{p}/moved.txt", 8, later), (f"{p}/grown.txt", 4, None), (f"{p}/lost.txt", 3, at)]
    candidates = spark.createDataFrame(rows, "path string, size_bytes long, modified_at timestamp")
    cache = cache_of(spark, [(f"{p}/hit.txt", 5, at, "h" * 64, "sha256"), (f"{p}/moved.txt", 8, at, "o" * 64, "sha256"),
                             (f"{p}/grown.txt", 3, None, "g" * 64, "sha256"), ("/other", 1, at, "x" * 64, "sha256")])
    hashed, fresh = D.hash_with_cache(candidates, cache)  # hit.txt does not exist: it could not be opened
    got = {r.path.rsplit("/", 1)[1]: (r.cache_hit, r.hash) for r in hashed.collect()}
    assert got == {"hit.txt": (True, "h" * 64), "miss é.bin": (False, hashlib.sha256(big).hexdigest()), "lost.txt": (False, None),
                   "moved.txt": (False, hashlib.sha256(b"new text").hexdigest()), "grown.txt": (False, hashlib.sha256(b"more").hexdigest())}
    kept = {r.path.rsplit("/", 1)[1]: r.hash for r in fresh.collect()}
    assert kept == {"other": "x" * 64, **{n: h for n, (_, h) in got.items() if h}}
    again, _ = D.hash_with_cache(candidates, fresh)
    assert {r.path.rsplit("/", 1)[1] for r in again.filter("not cache_hit").collect()} == {"lost.txt"}


def test_contents_of_hits_are_not_hashed_and_stay_in_the_scan(spark):
    at = datetime(2024, 1, 1)
    meta = spark.createDataFrame([(f"/f{i}", 9, at) for i in range(40)], "path string, size_bytes long, modified_at timestamp")
    cache = cache_of(spark, [(f"/f{i}", 9, at, f"{i:064d}", "sha256") for i in range(37)])
    contents = meta.select("path", F.concat(F.lit("text "), "path").alias("content"))
    hashed, _ = D.hash_with_cache(meta, cache, contents)
    got = {r.path: r.hash for r in hashed.collect()}
    assert got == {f"/f{i}": f"{i:064d}" if i < 37 else hashlib.sha256(f"text /f{i}".encode()).hexdigest() for i in range(40)}
    assert {r.path for r in D.listed_hashes(meta.limit(3), contents).collect()} == {"/f0", "/f1", "/f2"}
    plan = D.hash_files(meta, meta.withColumn("content", F.lit("x").cast("binary")))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in "".join(line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line)


def test_files_that_share_a_path_keep_their_own_hashes(spark):
    at = datetime(2024, 1, 1)
    meta = spark.createDataFrame([(1, "/same", 3, at), (2, "/same", 4, at), (3, "/same", 5, at)], "finding_id long, path string, size_bytes long, modified_at timestamp")
    contents = meta.select("finding_id", F.concat(F.lit("text "), F.col("finding_id").cast("string")).alias("content"))
    own = {i: hashlib.sha256(f"text {i}".encode()).hexdigest() for i in (1, 2, 3)}
    assert sorted((r.finding_id, r.hash) for r in D.hash_files(meta, contents, "finding_id").collect()) == sorted(own.items())
    empty = cache_of(spark, [])
    done, fresh = D.hash_with_cache(meta, empty, contents, "finding_id")
    assert sorted((r.finding_id, r.hash) for r in done.collect()) == sorted(own.items()) and fresh.count() == 3
    again, fresh = D.hash_with_cache(meta, fresh, contents, "finding_id")
    assert {r.finding_id: r.hash for r in again.filter("cache_hit").collect()} == own
    assert {r.hash for r in again.filter("finding_id = 1").collect()} == {own[1]} and fresh.count() == 3


def test_cached_hash_is_used_and_time_must_agree(spark):
    at = datetime(2024, 1, 1)
    f = D.hash_contents(files(spark, [("/cache-a.txt", "same", at), ("/cache-b.txt", "same", at)]))
    cache = spark.createDataFrame([("/cache-a.txt", 4, at, "0" * 64, "sha256")],
                                  "path string, size_bytes long, modified_at timestamp, hash string, algo string")
    hashed, fresh = D.hash_with_cache(f, cache)
    assert D.duplicate_groups(hashed.drop("cache_hit")).count() == 0
    assert fresh.count() == 2
    later = cache.withColumn("modified_at", F.lit(datetime(2024, 6, 1)))
    assert D.probe_hash_cache(f.drop("hash"), later).filter("cached_hash is not null").count() == 0


def test_hot_group_members_stay_whole(spark):
    """A third of all rows with one content: every member is listed once."""
    f = (spark.range(3000).select(
        F.lit(1).cast("long").alias("scan_id"), F.concat(F.lit("/f/"), F.col("id").cast("string")).alias("path"), F.lit("").alias("extension"),
        F.lit(None).cast("timestamp").alias("modified_at"), F.lit(10).cast("long").alias("size_bytes"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") - F.col("id") % 3 % 2).cast("string")).alias("hash")))
    groups = D.duplicate_groups(f)
    members = D.group_members(groups, f)
    expected = f.groupBy("hash").count().filter("count > 1").agg(F.sum("count")).first()[0]
    assert members.count() == expected == members.select("path").distinct().count()
    assert members.filter("hash = 'hot' and is_canonical").count() == 1


def test_join_hot_keeps_unmatched_rows_of_a_left_join(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    stats = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k < 3")
    out = skew.join_hot(rows, stats, ["k"], "n", ["id"], "left")
    assert out.count() == 100 and out.filter("n is null").count() == rows.filter("k >= 3").count()


def test_resolve_groups_checks_the_kept_file(spark):
    f = D.hash_contents(files(spark, [("/a", "one"), ("/b", "one"), ("/c", "two"), ("/d", "two"), ("/e", "tri"), ("/f", "tri")]))
    g = D.duplicate_groups(f).withColumn("status", F.lit("pending")).withColumn("saved_bytes", F.lit(0).cast("bigint"))
    h = {r.path: r.hash for r in f.collect()}
    d = spark.createDataFrame([(h["/a"], "keep_one", "/b"), (h["/c"], "keep_one", "/a"), (h["/e"], "ignore", None)],
                              "hash string, action string, keep_path string")
    done, errors = D.resolve_groups(g, f, d)
    got = {r.hash: (r.status, r.saved_bytes, r.canonical_path) for r in done.collect()}
    assert got[h["/a"]] == ("resolved", 3, "/b")
    assert got[h["/c"]][0] == "pending" and got[h["/e"]][:2] == ("ignored", 0)
    assert [r.error for r in errors.collect()] == ["kept file is not in the group"]


def test_findings_by_first_match(spark):
    rows = [("/a/x.txt", "ab"), ("/a/z.txt", ""), ("/a/z.dmg", ""), ("/a/d.idlk", "a"), ("/a/d.locked", "a"),
            ("/a/s.dmg", "a"), ("/a/s.zip", "a"), ("/a/big.dat", "x" * 60)]
    got = {r.name: (r.type, r.finding_status, r.risk_level) for r in FN.detect_findings(files(spark, rows), 50).collect()}
    assert got == {"z.txt": ("zero_byte", "safe_delete", "low"), "z.dmg": ("zero_byte", "safe_delete", "low"),
                   "d.idlk": ("idlk_file", "safe_delete", "low"), "d.locked": ("locked_file", "review", "high"),
                   "s.dmg": ("installer", "review", "medium"), "s.zip": ("archive", "review", "medium"),
                   "big.dat": ("large_file", "review", "medium")}


def test_large_file_reason_has_one_decimal(spark):
    f = files(spark, [("/v.mov", "a")]).withColumn("size_bytes", F.lit(60 * 1024 * 1024 + 52429).cast("long"))
    assert FN.detect_findings(f).first().reason == "Large file (60.1 MB) — verify it is still needed"


def test_empty_folder_ignores_system_clutter(spark):
    rows = [("/r", "r", True), ("/r/a", "a", True), ("/r/a/.DS_Store", ".DS_Store", False), ("/r/b", "b", True), ("/r/b/f", "f", False)]
    e = spark.createDataFrame(rows, "path string, name string, is_dir boolean").withColumn("scan_id", F.lit(1)).withColumn("modified_at", F.lit(None).cast("timestamp"))
    assert [(r.path, r.name) for r in FN.empty_folders(e).collect()] == [("/r/a", "a")]


CASES = [
    ("ghost.txt", ".txt", "zero_byte", "Temporary Files", "delete", True),
    ("doc.idlk", ".idlk", "idlk_file", "Lock Files", "delete", True),
    ("copy.pdf", ".pdf", "duplicate", "Duplicate Candidates", "review", False),
    ("setup.dmg", ".dmg", "installer", "Installers", "delete", False),
    ("invoice-march.pdf", ".pdf", None, "Invoices", "keep", True),
    ("tax-return-2025.pdf", ".pdf", None, "Tax", "keep", True),
    ("Screenshot 2025.png", ".png", None, "Screenshots", "review", False),
    ("shot.cr2", ".cr2", None, "Photography", "keep", False),
    ("package.json", ".json", None, "Web Development", "keep", True),
    ("main.py", ".py", None, "Software", "keep", True),
    ("clip.ts", ".ts", None, "Video", "review", False),
    ("zzz.qq", ".qq", None, "Unknown", "review", False),
]


def test_classifier_cases_and_invariants(spark):
    df = spark.createDataFrame([(f"/sample-data/{n}", n, e, 1024, t) for n, e, t, *_ in CASES],
                               "path string, name string, extension string, size_bytes long, finding_type string")
    got = {r.name: r.ai for r in C.classify(df).collect()}
    for name, _, _, category, action, safe in CASES:
        ai = got[name]
        assert (ai.category, ai.recommendation.action, ai.recommendation.safe) == (category, action, safe), name
        assert 0 <= ai.confidence <= 100 and ai.tags and ai.suggested_action
        assert ai.recommendation.requires_confirmation and ai.recommendation.reversible == (action != "delete")
    assert got["doc.idlk"].subcategory == "Adobe InDesign lock"
    assert got["invoice-march.pdf"].suggested_destination == "Documents/Invoices"
    assert got["zzz.qq"].confidence == 40


def test_keyword_order_and_folders(spark):
    rows = [("/home/legal/x", "x", ""), ("/home/Music/x", "x", ""), ("/a/statement of contract.pdf", "statement of contract.pdf", ".pdf"),
            ("/web/src/index.html", "index.html", ".html"), ("/brand/logo.svg", "logo.svg", ".svg")]
    df = spark.createDataFrame(rows, "path string, name string, extension string").withColumn("size_bytes", F.lit(5)).withColumn("finding_type", F.lit(None).cast("string"))
    got = {r.path: r.ai for r in C.classify(df).collect()}
    assert (got["/home/legal/x"].category, got["/home/legal/x"].confidence) == ("Legal", 72)
    assert (got["/home/Music/x"].category, got["/home/Music/x"].confidence) == ("Audio", 58)
    assert got["/a/statement of contract.pdf"].keyword == "contract"
    assert (got["/web/src/index.html"].confidence, got["/web/src/index.html"].keyword) == (92, "src")
    assert got["/brand/logo.svg"].category == "Branding"


def test_zip_beside_a_manifest(spark):
    rows = [("/p/package.json", "package.json", ".json"), ("/p/old.zip", "old.zip", ".zip"), ("/q/old.zip", "old.zip", ".zip")]
    df = spark.createDataFrame(rows, "path string, name string, extension string").withColumn("size_bytes", F.lit(5)).withColumn("finding_type", F.lit(None).cast("string"))
    got = {r.path: r.ai.rule for r in C.classify(C.beside_project(df)).collect()}
    assert got["/p/old.zip"] == "web_zip" and got["/q/old.zip"] == "unknown"


def test_every_rule_has_one_index():
    assert len(C.RULE_INDEX) == len(C.RULE_TABLE)
    assert {r[1] for r in C.RULE_TABLE} >= {c for _, c, *_ in K.DOCUMENT_TOPICS}


def test_path_policy(spark):
    good = ["/Users/a", "  /Users/a  ", "/Library/Application Support/x", "/usrlocal"]
    bad = {"": "empty", "   ": "empty", "/a/../b": "traversal", "rel/a": "not_absolute", "/a\0b": "null_byte", "/" + "a" * 4096: "too_long",
           "/System": "system_path", "/usr/local": "system_path", "/proc/1": "system_path", "/ETC/x": "system_path", "/Library/Frameworks/y": "system_path"}
    df = spark.createDataFrame([(p,) for p in [*good, *bad]], "path string")
    got = {r.path: r.reason for r in P.path_policy(df).collect()}
    assert all(got[p] is None for p in good) and {p: got[p] for p in bad} == bad


def test_approved_roots_are_segment_aligned(spark):
    paths = spark.createDataFrame([("/home/ann",), ("/home/ann/x",), ("/home/annex",)], "path string")
    roots = spark.createDataFrame([("/home/ann/",)], "path string")
    assert sorted(r.path for r in P.within_roots(paths, roots).collect()) == ["/home/ann", "/home/ann/x"]
    assert P.within_roots(paths, roots.limit(0)).count() == 0


def test_pruned_folders(spark):
    paths = ["/a/src/x", "/a/node_modules/x", "/a/My.APP/x", "/a/dist", "/a/Build/x", "/a/b.kext/c/d"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in P.prune_paths(df).collect()) == ["/a/Build/x", "/a/dist", "/a/src/x"]


def test_inventory_extraction_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text('{"b":1.0,"a":[true,null],"2":"é"}')
    (tmp_path / "in" / "sub" / "bad.json").write_text("{oops")
    (tmp_path / "in" / "sub" / "p.pdf").write_bytes(b"BT (Hello) Tj (x) Tj (wide world) Tj ET")
    (tmp_path / "in" / "n.MD").write_text("# hi")
    (tmp_path / "in" / "i.bin").write_bytes(b"\x00\x01")
    inv = S.file_inventory(spark, str(tmp_path / "in"))
    assert "content" not in inv._jdf.queryExecution().executedPlan().toString()
    assert inv.count() == 5
    t = {r.name: (r.extractor, r.text) for r in S.extract_text(inv.join(S.file_contents(spark, str(tmp_path / "in")), "path")).collect()}
    assert t["a.json"] == ("json", '{\n  "2": "é",\n  "b": 1,\n  "a": [\n    true,\n    null\n  ]\n}')
    assert t["bad.json"] == ("json", "{oops") and t["p.pdf"] == ("pdf", "Hello wide world")
    assert t["n.MD"] == ("markdown", "# hi") and t["i.bin"] == (None, None)
    found = FN.detect_findings(inv).withColumn("finding_type", F.col("type")).withColumn("finding_id", F.xxhash64("path"))
    c = C.classify(found)
    tags = C.semantic_tags(c).unionByName(C.semantic_tags(c))
    S.write_scan(str(tmp_path / "out"), found.drop("content"), c.select("finding_id", "ai"), tags, inv)
    assert spark.read.parquet(str(tmp_path / "out" / "files")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out" / "semantic_tags")).count() == tags.distinct().count()


def test_validation_splits_rows(spark):
    df = spark.createDataFrame([("a", "review"), ("b", "nope"), (None, "review")], "path string, finding_status string")
    good, bad = FN.split_valid(df, {"finding_status": "finding_status"}, ["path"])
    assert good.count() == 1 and sorted(e for r in bad.collect() for e in r.errors) == ["finding_status not allowed: nope", "path is required"]


def test_long_texts_stay_whole(spark):
    """A text beyond the display limit keeps its end; the limit is a choice."""
    text = "word " * 60_000 + "last@end.org"
    files = spark.createDataFrame([(1, ".txt", text.encode()), (2, ".pdf", f"BT ({text}) Tj ET".encode()), (3, ".txt", None)],
                                  "finding_id long, extension string, content binary")
    whole = {r.finding_id: r for r in S.extract_text(files).collect()}
    assert whole[1].text == whole[2].text == text and not whole[1].truncated and whole[3].text is None
    cut = {r.finding_id: r for r in S.extract_text(files, limit=200_000).collect()}
    assert len(cut[1].text) == 200_000 and cut[1].truncated


def test_scan_written_again_replaces_itself(spark, tmp_path):
    found = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "scan_id long, finding_id long")
    tags = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (2, 20, "b")], "scan_id long, finding_id long, tag string")
    out = str(tmp_path / "scans")
    for part in (found, found.where("scan_id = 1")):
        keep = tags.join(part, ["scan_id", "finding_id"], "left_semi")
        S.write_scan(out, part, part, keep, part)
    got = spark.read.parquet(f"{out}/findings")
    assert sorted((r.scan_id, r.finding_id) for r in got.collect()) == [(1, 10), (1, 11), (2, 20)]
    assert spark.read.parquet(f"{out}/semantic_tags").count() == 2


def test_scans_share_folders(spark, tmp_path):
    """Files follow blocks of 64 scans, however the rows were dealt; a scan written again leaves its neighbours whole."""
    rows = spark.range(0, 2000).select((F.col("id") % 200).alias("scan_id"), F.col("id").alias("finding_id"), F.lit("a").alias("tag"))
    rows = rows.union(rows.selectExpr("cast(null as long)", "finding_id + 10000", "tag").limit(3)).repartition(8)
    out = str(tmp_path / "blocks")
    S.write_scan(out, rows, rows, rows, rows)
    for table in ("findings", "ai_classifications", "semantic_tags", "files"):
        assert len(list((tmp_path / "blocks" / table).glob("*/*.parquet"))) <= 5 * 4
    again = spark.createDataFrame([(7, 99), (300, 98)], "scan_id long, finding_id long")
    S.write_scan(out, again, again, again.withColumn("tag", F.lit("b")), again)
    for table in ("findings", "semantic_tags"):
        got = [(r.scan_id, r.finding_id, r.tag) for r in spark.read.parquet(f"{out}/{table}").collect()]
        new = None if table == "findings" else "b"
        want = [(r.scan_id, r.finding_id, r.tag) for r in rows.collect() if r.scan_id != 7] + [(7, 99, new), (300, 98, new)]
        assert sorted(got, key=str) == sorted(want, key=str)
