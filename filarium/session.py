"""Local session for tests and benchmarks, and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "filarium") -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (SparkSession.builder.master(f"local[{n}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(n))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("FILARIUM_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffle files go with the end of each query that runs inside, whose written rows alone are read from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder the cluster names in ``spark.checkpoint.dir``.

    The folder must outlive executors, so a temporary one is made only for a
    local master.
    """
    checkpoint_folder(df.sparkSession)
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new query, which takes the setting


def write_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as compressed Parquet in the shared folder, for tables with long values; a checkpoint is not compressed."""
    out = checkpoint_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
