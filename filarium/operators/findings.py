"""Finding detection and the small category rules around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from filarium import constants as K
from filarium.functions import basename, half_up_div, lookup, parent


def finding_of(name: Column, size: Column, ext: Column, large_bytes: int) -> Column:
    """Struct(type, finding_status, reason); null for an ordinary file."""
    def made(kind, status, reason):
        return F.struct(F.lit(kind).alias("type"), F.lit(status).alias("finding_status"),
                        reason.alias("reason"))

    def text(template, *args):
        return F.format_string(template, *args) if args else F.lit(template)

    return (F.when(size == 0, made("zero_byte", "safe_delete", text(K.REASON_ZERO)))
            .when(ext == ".idlk", made("idlk_file", "safe_delete", text(K.REASON_IDLK)))
            .when(ext == ".locked", made("locked_file", "review", text(K.REASON_LOCKED)))
            .when(ext.isin(K.INSTALLER_EXTS), made("installer", "review", text(K.REASON_INSTALLER, ext)))
            .when(ext.isin(K.ARCHIVE_EXTS), made("archive", "review", text(K.REASON_ARCHIVE, ext)))
            .when(size > large_bytes, made("large_file", "review",
                                           text(K.REASON_LARGE, half_up_div(size, 1048576, 1)))))


def detect_findings(entries: DataFrame, large_bytes: int = K.LARGE_FILE_BYTES) -> DataFrame:
    """Files with a type finding, first matching rule wins."""
    hit = finding_of(F.col("name"), F.col("size_bytes"), F.col("extension"), large_bytes)
    return (entries.withColumn("_f", hit).filter("_f is not null")
            .select("*", "_f.*").drop("_f")
            .withColumn("risk_level", risk_level(F.col("type"), F.col("finding_status"))))


def risk_level(kind: Column, status: Column) -> Column:
    """Risk from type and status (C4); a safe delete is low before lock types count."""
    return (F.when(kind.isin("zero_byte", "empty_folder") | (status == "safe_delete"), "low")
            .when(kind.isin("large_file", "duplicate", "installer", "archive"), "medium")
            .when(kind.isin("locked_file", "idlk_file"), "high")
            .otherwise("low"))


def ext_category(ext: Column) -> Column:
    """Display category of an extension."""
    table = {e: cat for cat, exts in reversed(list(K.EXT_CATEGORIES.items())) for e in exts}
    return lookup(ext, table, F.lit(K.EXT_CATEGORY_OTHER))


def file_status(kind: Column) -> Column:
    """File status from its finding type; a null type means ready."""
    return (F.when(kind.isNull(), "ready")
            .when(kind.isin("zero_byte", "empty_folder"), "corrupted")
            .when(kind.isin("idlk_file", "locked_file"), "action_required")
            .otherwise("review"))


def childless_dirs(entries: DataFrame) -> DataFrame:
    """Folders without a visible child (J11); system clutter does not count."""
    visible = entries.filter((F.col("name") != ".DS_Store") & ~F.col("name").startswith("._"))
    parents = visible.select(parent(F.col("path")).alias("path")).distinct()
    return entries.filter("is_dir").join(parents, "path", "left_anti")


def empty_folders(entries: DataFrame) -> DataFrame:
    """Findings for empty folders."""
    return childless_dirs(entries).select(
        "scan_id", "path", basename(F.col("path")).alias("name"), F.lit("").alias("extension"),
        F.lit(0).cast("bigint").alias("size_bytes"), "modified_at",
        F.lit("empty_folder").alias("type"), F.lit("safe_delete").alias("finding_status"),
        F.lit(K.REASON_FOLDER).alias("reason"), F.lit("low").alias("risk_level"))


def duplicate_findings(members: DataFrame) -> DataFrame:
    """Findings for members of confirmed duplicate groups."""
    return (members
            .withColumn("type", F.lit("duplicate"))
            .withColumn("finding_status", F.lit("duplicate"))
            .withColumn("reason", F.format_string(K.REASON_DUPLICATE, F.substring("hash", 1, 8)))
            .withColumn("risk_level", F.lit("medium")))


def all_findings(*parts: DataFrame) -> DataFrame:
    """Union of finding tables with a deterministic id."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.withColumn("finding_id", F.xxhash64("scan_id", "path", "type"))


def files_table(entries: DataFrame, ai_category: Column, ai_tags: Column,
                large_bytes: int = K.LARGE_FILE_BYTES) -> DataFrame:
    """Inventory row for every file: category and tags of its finding, if any."""
    hit = finding_of(F.col("name"), F.col("size_bytes"), F.col("extension"), large_bytes)
    return (entries.withColumn("_t", hit["type"])
            .withColumn("category", F.when(F.col("_t").isNull(), ext_category(F.col("extension")))
                        .otherwise(ai_category))
            .withColumn("status", file_status(F.col("_t")))
            .withColumn("tags", F.when(F.col("_t").isNull(), F.array().cast("array<string>"))
                        .otherwise(ai_tags))
            .drop("_t"))


def scan_totals(entries: DataFrame, findings: DataFrame, groups: DataFrame,
                candidates: DataFrame) -> DataFrame:
    """Per scan: files, folders, bytes, findings, groups, hashes."""
    e = entries.groupBy("scan_id").agg(
        F.count_if(~F.col("is_dir")).alias("files_scanned"),
        F.count_if(F.col("is_dir")).alias("folders_scanned"),
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size_bytes"))), F.lit(0)).alias("bytes_scanned"))
    f = findings.groupBy("scan_id").agg(F.count("*").alias("findings_count"))
    g = groups.groupBy("scan_id").agg(F.count("*").alias("duplicates_found"))
    c = candidates.groupBy("scan_id").agg(F.count("*").alias("hashes_total"),
                                          F.count("hash").alias("hashes_computed"))
    out = e
    for other in (f, g, c):
        out = out.join(other, "scan_id", "left")
    return out.fillna(0)


def validate(df: DataFrame, enums: dict[str, str], required: list[str] = ()) -> DataFrame:
    """Add ``errors``: the columns that are missing or hold a value not allowed (V1).

    ``enums`` maps a column to the name of its allowed-value list.
    """
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required]
    checks += [F.when(~F.col(c).isin(K.ENUMS[e]), F.concat(F.lit(f"{c} not allowed: "), F.col(c)))
               for c, e in enums.items()]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def split_valid(df: DataFrame, enums: dict[str, str], required: list[str] = ()):
    """(good rows, quarantined rows with their errors)."""
    checked = validate(df, enums, required)
    return (checked.filter(F.size("errors") == 0).drop("errors"),
            checked.filter(F.size("errors") > 0))
