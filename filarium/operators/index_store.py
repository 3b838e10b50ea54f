"""A stored vector index whose parts are replaced.

An update compares hashes of the texts with those of the last version, embeds only texts that are new
or changed, and writes them beside the older rows together with the list of findings they replace.
A manifest, written last, names the tables of a version; readers take the newest manifest, so an
update that breaks leaves the version before it. One writer at a time.

Findings without an id are not indexed; a null text counts as an empty one and has no chunks. A text
that was extracted again without a change keeps its chunks, and so the extraction they came from.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from filarium.operators.skew import latest
from filarium.operators.vectors import build_index

#: A read joins the replaced findings of at most so many updates; the next one writes a new base.
MAX_UPDATES = 16


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    fs, pattern = _fs(spark, f"{out}/manifest-*.json")
    names = [s.getPath().getName() for s in fs.globStatus(pattern) or []]
    return sorted(int(n[len("manifest-"):-len(".json")]) for n in names)


def manifest(spark: SparkSession, out: str, version: int | None = None) -> dict:
    """Tables of a version (the newest unless one is named); of an index not yet written, none."""
    if version is None:
        version = max(versions(spark, out), default=0)
    if version == 0:
        return {"version": 0, "data": [], "replaced": [], "texts": None}
    return json.loads(spark.read.text(f"{out}/manifest-{version:010d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, out: str, before: dict, **tables) -> dict:
    """Name the tables of the next version; refused if another writer named one in between."""
    now = {**before, **tables, "version": before["version"] + 1}
    fs, final = _fs(spark, f"{out}/manifest-{now['version']:010d}.json")
    _, draft = _fs(spark, f"{out}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(now).encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {now['version']} of {out} was written by another update")
    return now


def _texts(spark: SparkSession, state: dict, key_type: str, key: str) -> DataFrame:
    """(key, text_hash) of the findings of a version."""
    if state["texts"] is None:
        return spark.createDataFrame([], f"`{key}` {key_type}, text_hash string")
    return spark.read.parquet(state["texts"]).where("kind <> 'gone'").select(key, "text_hash")


def update(out: str, extracted: DataFrame, key: str = "finding_id", whole: bool = True, build=build_index) -> dict:
    """Bring the index in ``out`` to the newest texts of ``extracted``; returns the manifest.

    With ``whole`` findings that are no longer extracted leave the index; otherwise only those in
    ``extracted`` are replaced. ``build`` turns extractions into chunks with vectors.
    """
    spark = extracted.sparkSession
    state = manifest(spark, out)
    hashed = extracted.where(F.col(key).isNotNull()).withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    # hashes only are shuffled here; texts of unchanged findings never are
    now = latest(hashed.select(key, "created_at", "extracted_id", "text_hash"), [key], ["created_at", "extracted_id", "text_hash"])
    old = _texts(spark, state, extracted.schema[key].dataType.simpleString(), key).withColumnRenamed("text_hash", "old_hash")
    kind = (F.when(F.col("text_hash").isNull(), "gone" if whole else "same").when(F.col("old_hash").isNull(), "new")
            .when(F.col("old_hash") == F.col("text_hash"), "same").otherwise("changed"))
    changes = f"{out}/texts-{uuid.uuid4().hex}"
    (now.join(old, key, "full").select(key, F.coalesce("text_hash", "old_hash").alias("text_hash"), kind.alias("kind"))
     .sortWithinPartitions("kind").write.parquet(changes))
    todo = spark.read.parquet(changes).where("kind in ('new', 'changed')").select(key, "text_hash")
    data = f"{out}/data-{uuid.uuid4().hex}"
    build(hashed.join(todo, [key, "text_hash"], "left_semi").drop("text_hash"), key).write.parquet(data)
    n = state["version"] + 1
    done = _commit(spark, out, state, data=state["data"] + [[n, data]], texts=changes,
                   replaced=state["replaced"] + ([[n, changes]] if state["data"] else []))
    return compact(spark, out, key) if len(done["replaced"]) > MAX_UPDATES else done


def remove(spark: SparkSession, out: str, ids: DataFrame | None = None, key: str = "finding_id") -> dict:
    """Take the given findings out of the index, or all of them."""
    state = manifest(spark, out)
    if ids is None or not state["data"]:
        return _commit(spark, out, state, data=[], replaced=[], texts=None)
    have = spark.read.parquet(state["texts"]).where("kind <> 'gone'").select(key, "text_hash")
    named = ids.select(key).distinct().withColumn("kind", F.lit("gone"))
    changes = f"{out}/texts-{uuid.uuid4().hex}"
    (have.join(named, key, "left").select(key, "text_hash", F.coalesce("kind", F.lit("same")).alias("kind"))
     .sortWithinPartitions("kind").write.parquet(changes))
    done = _commit(spark, out, state, texts=changes, replaced=state["replaced"] + [[state["version"] + 1, changes]])
    return compact(spark, out, key) if len(done["replaced"]) > MAX_UPDATES else done


def read(spark: SparkSession, out: str, key: str = "finding_id", version: int | None = None) -> DataFrame:
    """Chunks of a version (the newest unless one is named).

    Rows lose against a later update that replaced or removed their finding. Nothing is joined
    before the first such update.
    """
    state = manifest(spark, out, version)
    if not state["data"]:
        raise FileNotFoundError(f"{out} holds no index")
    rows = None
    for n, path in state["data"]:
        part = spark.read.parquet(path).withColumn("_version", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    stale = None
    for n, path in state["replaced"]:
        part = spark.read.parquet(path).where("kind in ('changed', 'gone')").select(key, F.lit(n).alias("_until"))
        stale = part if stale is None else stale.union(part)
    if stale is not None:
        stale = stale.groupBy(F.col(key).alias("_key")).agg(F.max("_until").alias("_until"))
        rows = rows.join(stale, (F.col(key) == F.col("_key")) & (F.col("_version") < F.col("_until")), "left_anti")
    return rows.drop("_version")


def compact(spark: SparkSession, out: str, key: str = "finding_id") -> dict:
    """The same index as one table without replaced rows."""
    state = manifest(spark, out)
    if not state["data"]:
        return state
    data = f"{out}/data-{uuid.uuid4().hex}"
    read(spark, out, key).write.parquet(data)
    return _commit(spark, out, state, data=[[state["version"] + 1, data]], replaced=[])
