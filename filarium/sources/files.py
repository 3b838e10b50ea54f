"""Reading inventories and file contents, writing results."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from filarium import constants as K
from filarium.functions import ext_norm, extension, lookup, trim_ws
from filarium.session import cut_lineage


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small scan before heavy work on it.

    An input with fewer splits than cores is redistributed; a large one already
    has many more splits than cores and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_inventory(spark: SparkSession, root: str, scan_id: int = 1) -> DataFrame:
    """Every file below a root (S1). File contents are never read: the column is pruned."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*").load(root))
    path = F.regexp_replace("path", r"^file:/*", "/")
    return listing.select(
        F.lit(scan_id).cast("bigint").alias("scan_id"), path.alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        extension(F.element_at(F.split("path", "/"), -1)).alias("extension"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        F.lit(False).alias("is_dir"))


def file_contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below a root."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content"))


def extractor_for(ext: Column) -> Column:
    """Extractor kind of an extension, null if none can read it."""
    return lookup(ext_norm(ext), {e: kind for kind, exts in K.EXTRACTOR_KINDS.items() for e in exts})


def clip_text(text: Column, limit: int | None = K.MAX_TEXT_CHARS) -> Column:
    """Struct(text, truncated): a display form of limited length (S7); whole without a limit."""
    if limit is None:
        return F.struct(text.alias("text"), F.when(text.isNotNull(), F.lit(False)).alias("truncated"))
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


def pdf_text(raw: Column) -> Column:
    """Text of the simple show operators ``(..) Tj``."""
    shown = F.regexp_extract_all(raw, F.lit(r"\(([^()\\]{2,})\)\s*Tj"), F.lit(1))
    return trim_ws(F.array_join(shown, " "))


_INDEX_KEY = re.compile(r"(0|[1-9]\d{0,9})$")


def _ordered(pairs):
    """Object members the way the reader keeps them: index keys first, ascending."""
    out = dict(pairs)
    index = sorted((k for k in out if _INDEX_KEY.match(k)), key=int)
    return {k: out[k] for k in index + [k for k in out if not _INDEX_KEY.match(k)]}


def _number(text: str):
    v = float(text)
    return int(v) if v.is_integer() and abs(v) < 1e21 else v


@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """Two-space JSON, or the text itself if it is not valid JSON."""
    def one(text):
        try:
            value = json.loads(text, object_pairs_hook=_ordered, parse_int=_number, parse_float=_number,
                               parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
            return json.dumps(value, indent=2, ensure_ascii=False)
        except (ValueError, TypeError, RecursionError):
            return text
    return texts.map(one)


def extract_text(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Add extractor, text and truncated to files with ``content``.

    Texts stay whole unless a limit in characters is given.

    Files no extractor can read keep a null extractor and text. Only JSON files
    pass through Python; everything else stays in one JVM projection.
    """
    kind = extractor_for(F.col("extension"))
    raw = files.withColumn("extractor", kind)
    plain = raw.filter("extractor is null or extractor <> 'json'").withColumn(
        "_t", F.when(F.col("extractor") == "pdf", pdf_text(F.decode(F.col("content").cast("binary"), "ISO-8859-1")))
        .when(F.col("extractor").isNotNull(), F.decode(F.col("content").cast("binary"), "UTF-8")))
    as_json = raw.filter("extractor = 'json'").withColumn(
        "_t", pretty_json(F.decode(F.col("content").cast("binary"), "UTF-8")))
    both = plain.unionByName(as_json).drop("content").withColumn("_c", clip_text(F.col("_t"), limit))
    return both.select("*", "_c.text", "_c.truncated").drop("_t", "_c")


def extract_with(files: DataFrame, reader: Column) -> DataFrame:
    """Fill texts no built-in extractor could read from a caller's column, e.g. a
    pandas UDF doing OCR (UD3). Nothing is called unless the caller passes one."""
    base = files.withColumn("_other", reader)
    done = extract_text(base)
    use = F.col("extractor").isNull() & F.col("_other").isNotNull()
    return (done.withColumn("text", F.when(use, F.col("_other")).otherwise(F.col("text")))
            .withColumn("truncated", F.when(use, F.lit(False)).otherwise(F.col("truncated")))
            .withColumn("extractor", F.when(use, F.lit("ocr")).otherwise(F.col("extractor")))
            .drop("_other"))


def write_scan(out: str, findings: DataFrame, classifications: DataFrame, tags: DataFrame,
               files: DataFrame, mode: str = "overwrite") -> None:
    """Write the tables of a scan, a folder for each 64 neighbouring scans.

    A scan written again replaces its own rows and leaves those of other scans, which are written
    anew with their folder: one writer at a time. Tables without a scan are replaced as a whole. All
    tables grow with ``mode="append"``.
    """
    tables = {"findings": findings, "ai_classifications": classifications,
              "semantic_tags": tags.dropDuplicates(["finding_id", "tag"]), "files": files}
    for name, df in tables.items():
        path = f"{out}/{name}"
        if "scan_id" in df.columns:
            if mode == "overwrite":
                df = _with_neighbours(df, path)
            # a folder's rows come together, so that files follow the folders and not tasks times folders; a large one is split
            df = df.withColumn("scan_block", _scan_block()).hint("rebalance", "scan_block")
            df.write.mode(mode).partitionBy("scan_block").option("partitionOverwriteMode", "dynamic").parquet(path)
        else:
            df.write.mode(mode).parquet(path)


def _scan_block() -> Column:
    return F.shiftright("scan_id", 6)


def _with_neighbours(df: DataFrame, path: str) -> DataFrame:
    """The rows, and those of other scans in the folders of the table at ``path`` that they replace."""
    try:
        old = df.sparkSession.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:  # no table, or one without rows
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return df
    df = cut_lineage(df)  # used three times, and must name the same scans each time
    scans = df.select(F.col("scan_id").alias("_scan"), _scan_block().alias("_block")).distinct()
    blocks = scans.select("_block").distinct()
    others = (old.join(blocks, F.col("scan_block").eqNullSafe(F.col("_block")), "left_semi")
              .join(scans.select("_scan"), F.col("scan_id").eqNullSafe(F.col("_scan")), "left_anti").drop("scan_block"))
    return df.unionByName(others, allowMissingColumns=True)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``value``, ready for a text sink."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def _column(kind: pa.DataType, column: pa.Array, ends: np.ndarray, *data: pa.Buffer | pa.Array) -> pa.Array:
    """Array of lists or bytes with the nulls of ``column``, from the ends of its rows and all their values."""
    known = pa.py_buffer(np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    offsets = pa.py_buffer(np.r_[0, ends].astype("<i4").tobytes())
    buffers, children = ([known, offsets, *data], []) if pa.types.is_binary(kind) else ([known, offsets], list(data))
    return pa.Array.from_buffers(kind, len(column), buffers, children=children)


@F.arrow_udf(T.BinaryType())
def pack_vector(vectors: pa.Array) -> pa.Array:
    """array<float> to little-endian float32 bytes, a batch at a time; a null component becomes NaN."""
    values = vectors.flatten().cast(pa.float32()).fill_null(float("nan")).to_numpy().astype("<f4")
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    return _column(pa.binary(), vectors, np.cumsum(sizes) * 4, pa.py_buffer(values.tobytes()))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_vector(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to array<float>, a batch at a time."""
    sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy().astype(np.int64)
    if (sizes % 4).any():
        raise ValueError("packed vectors are whole 4-byte numbers")
    values = np.frombuffer(b"".join(blobs.drop_null().to_pylist()), "<f4")
    return _column(pa.list_(pa.float32()), blobs, np.cumsum(sizes) // 4, pa.array(values, pa.float32()))
