"""A stored index: parts replaced, broken writes, removal, versions; the tables of a scan read back."""

import pytest
from pyspark.sql import functions as F

from filarium.operators import index_store as I, vectors as V

SCHEMA = "finding_id long, created_at long, extracted_id long, text string, chunk_id string, kind string"


def extractions(spark, rows):
    return spark.createDataFrame([(f, t, t, text, "x", "y") for f, t, text in rows], SCHEMA)


def content(index):
    return sorted((r.finding_id, r.chunk_index, r.chunk_text, r.chunk_id, tuple(r.vector), r.model) for r in index.collect())


OLD = [(1, 1, "first report of the year"), (2, 1, "second report"), (3, 1, None), (4, 1, "gone later"), (None, 1, "no id"), (5, 1, "")]
NEW = [(1, 1, "first report of the year"), (1, 2, "first report of the year"), (2, 1, "second report"), (2, 2, "second report, corrected"),
       (2, 2, "second report, corrected"), (3, 2, "now with text. " * 100), (6, 1, "brand new"), (5, 1, ""), (None, 3, "still no id")]


def test_changed_texts_only(spark, tmp_path):
    out = str(tmp_path)
    assert I.update(out, extractions(spark, OLD))["version"] == 1
    assert content(I.read(spark, out)) == content(V.build_index(extractions(spark, OLD).where("finding_id is not null")))
    last = I.update(out, extractions(spark, NEW))
    full = content(V.build_index(extractions(spark, NEW).where("finding_id is not null")))
    assert content(I.read(spark, out)) == full
    embedded = spark.read.parquet(last["data"][-1][1])
    assert {r.finding_id for r in embedded.collect()} == {2, 3, 6}  # 1 was extracted again without a change
    assert content(I.read(spark, out, version=1)) == content(V.build_index(extractions(spark, OLD).where("finding_id is not null")))
    # nothing changes: nothing is embedded
    assert spark.read.parquet(I.update(out, extractions(spark, NEW))["data"][-1][1]).count() == 0
    assert content(I.read(spark, out)) == full
    assert I.compact(spark, out)["replaced"] == [] and content(I.read(spark, out)) == full


def test_named_findings_only(spark, tmp_path):
    out = str(tmp_path)
    I.update(out, extractions(spark, OLD))
    I.update(out, extractions(spark, [(2, 5, "other words")]), whole=False)
    got = {r.finding_id: r.chunk_text for r in I.read(spark, out).collect()}
    assert got == {1: "first report of the year", 2: "other words", 4: "gone later"}
    # back to an earlier text
    I.update(out, extractions(spark, [(2, 6, "second report")]), whole=False)
    assert {r.finding_id: r.chunk_text for r in I.read(spark, out).collect()}[2] == "second report"


def test_broken_update_leaves_the_old_state(spark, tmp_path):
    out = str(tmp_path)
    I.update(out, extractions(spark, OLD))
    before = content(I.read(spark, out))

    def broken(rows, key):
        return V.build_index(rows, key).withColumn("model", F.when(F.col(key) == 6, F.raise_error(F.lit("no model"))).otherwise("m"))

    with pytest.raises(Exception, match="no model"):
        I.update(out, extractions(spark, NEW), build=broken)
    assert I.versions(spark, out) == [1] and content(I.read(spark, out)) == before
    # a writer that started from the same version is refused
    state = I.manifest(spark, out)
    I.update(out, extractions(spark, NEW))
    with pytest.raises(RuntimeError, match="another update"):
        I._commit(spark, out, state, data=[])
    assert len(content(I.read(spark, out))) > len(before)


def test_remove_and_come_back(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    I.update(out, extractions(spark, OLD))
    I.remove(spark, out, spark.createDataFrame([(1,), (1,), (99,), (None,)], "finding_id long"))
    assert {r.finding_id for r in I.read(spark, out).collect()} == {2, 4}
    I.update(out, extractions(spark, OLD))
    assert {r.finding_id for r in I.read(spark, out).collect()} == {1, 2, 4}
    monkeypatch.setattr(I, "MAX_UPDATES", 2)
    state = I.update(out, extractions(spark, NEW))
    assert len(state["data"]) == 1 and state["replaced"] == []
    assert {r.finding_id for r in I.read(spark, out).collect()} == {1, 2, 3, 6}
    I.remove(spark, out)
    with pytest.raises(FileNotFoundError):
        I.read(spark, out)
    I.update(out, extractions(spark, NEW).limit(0))
    assert I.read(spark, out).count() == 0
    I.update(out, extractions(spark, NEW))
    assert {r.finding_id for r in I.read(spark, out).collect()} == {1, 2, 3, 6}
