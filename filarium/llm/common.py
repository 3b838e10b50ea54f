"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters between words: space, and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_FOLDERS: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="run-")
    return _FOLDERS[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end, since only the written table is read from then on.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: rows (id, component), component the smallest id reached.

    Alternates the two star steps: every vertex links its larger neighbours to the smallest
    vertex it sees, then its smaller ones. Edges lie in the shared folder between rounds;
    minima combine before the shuffle, and the joins on vertices are ones that adaptive
    execution can split. Only a count and a checksum reach the driver.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    e = stored(e, "edges")
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")),
                                                               F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("p"))
                 .select(F.col("p.x").alias("u"), F.col("p.y").alias("v")).where("u > v").distinct())
        e = stored(small, "edges")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now
