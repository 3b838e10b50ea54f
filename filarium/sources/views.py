"""Engine tables derived from the test tables (the mapping is part of the tests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filarium.functions import extension, strings
from filarium.sources.files import load, spread

EXTS = [".pdf", ".docx", ".txt", ".xlsx", ".csv", ".jpg", ".png", ".cr2", ".mp4", ".mp3", ".py", ".html",
        ".zip", ".dmg", ".psd", ".svg", ".idlk", ".locked", ".lock", ".tmp", ".log", ".iso", ".json", ".md",
        "", ".ts", ".gz"]
STEMS = ["invoice", "tax-return", "contract", "bank_statement", "receipt", "Screenshot", "logo", "photo",
         "meeting-minutes", "resume", "passport", "medical-report", "floor plan", "deed", "proposal",
         "holiday", "notes", "server-log", "Report Final"]
FOLDERS = ["Documents", "Documents/Legal", "Photos/Album", "src/components", "Design", "Music", "videos",
           "logs", "finance", "Downloads", "home improvement"]


def _nth(values: list[str], n: Column) -> Column:
    return F.element_at(strings(values), (n % len(values) + 1).cast("int"))


def files_v(spark: SparkSession, sf: str, content: bool = True) -> DataFrame:
    """Files from ``documents``: every rule, extension and folder occurs."""
    i = F.col("doc_id")
    name = F.when(i % 41 == 0, "package.json").otherwise(
        F.concat(_nth(STEMS, i), F.lit("-"), i.cast("string"), _nth(EXTS, i)))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                    _nth(FOLDERS, F.floor(i / 7)), F.lit("/"), name)
    d = spread(load(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", *(["text"] if content else [])))
    cols = [i.alias("finding_id"), (F.floor(i / 250) + 1).alias("scan_id"), name.alias("name"), path.alias("path"),
            F.when(i % 97 == 0, F.lit(0)).otherwise(F.col("n_chars") * 4096).cast("bigint").alias("size_bytes"),
            F.timestamp_add("MINUTE", i % 525600, F.lit("2024-01-01").cast("timestamp")).alias("modified_at")]
    if content:
        cols.append(F.col("text").alias("content"))
    out = d.select(*cols).withColumn("created_at", F.col("modified_at")).withColumn("is_dir", F.lit(False))
    return out.withColumn("extension", extension(F.col("name")))


def entries_v(spark: SparkSession, sf: str) -> DataFrame:
    """A file tree from ``pages``: hosts, language folders, pages and draft folders
    that hold nothing but system clutter."""
    p = load(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("lang"), F.length("html").alias("n"))
    base = F.concat(F.lit("/"), F.col("host"), F.lit("/"), F.col("lang"))
    at = F.timestamp_add("HOUR", F.col("page_id"), F.lit("2024-01-01").cast("timestamp"))

    def row(path, name, size, is_dir, when=None):
        r = F.struct(path.alias("path"), name.alias("name"), size.cast("bigint").alias("size_bytes"),
                     F.lit(is_dir).alias("is_dir"))
        return r if when is None else F.when(when, r)

    page = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))
    drafts = F.concat(base, F.lit("/drafts-"), (F.col("page_id") % 5).cast("string"))
    zero = F.lit(0)
    rows = F.array(
        row(F.concat(F.lit("/"), F.col("host")), F.col("host"), zero, True),
        row(base, F.col("lang"), zero, True),
        row(drafts, F.concat(F.lit("drafts-"), (F.col("page_id") % 5).cast("string")), zero, True),
        row(F.concat(base, F.lit("/"), page), page, F.col("n"), False),
        row(F.concat(drafts, F.lit("/.DS_Store")), F.lit(".DS_Store"), F.lit(8), False, F.col("page_id") % 3 == 0),
        row(F.concat(drafts, F.lit("/note.txt")), F.lit("note.txt"), F.lit(9), False, F.col("page_id") % 4 == 0))
    flat = (p.select(at.alias("modified_at"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
            .select("r.*", "modified_at"))
    return (flat.groupBy("path", "name", "is_dir").agg(F.max("size_bytes").alias("size_bytes"),
                                                       F.max("modified_at").alias("modified_at"))
            .withColumn("scan_id", F.lit(1).cast("bigint")).withColumn("extension", extension(F.col("name"))))


def inventory_v(spark: SparkSession, sf: str) -> DataFrame:
    """A large inventory from ``lineitem``."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = (F.when((flag == "A") & (line == "F"), "corrupted").when(flag == "A", "action_required")
              .when(flag == "R", "review").otherwise("ready"))
    cats = ["Legal", "Banking", "Design", "Media", "Documents", "Other"]
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"),
                 _nth(EXTS, F.col("l_partkey"))).alias("name"),
        _nth(EXTS, F.col("l_partkey")).alias("extension"),
        _nth(cats, F.col("l_suppkey")).alias("category"), status.alias("status"),
        F.floor(F.col("l_extendedprice")).alias("size_bytes"),
        F.when(F.col("l_tax") > 0.04, F.array(line)).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.col("l_shipdate").cast("timestamp").alias("modified_at"))


def scans_v(spark: SparkSession, sf: str) -> DataFrame:
    """Scans from ``orders``."""
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    started = F.col("o_orderdate").cast("timestamp")
    return load(spark, sf, "orders").select(
        k.alias("scan_id"), F.concat(F.lit("/home/user"), (F.col("o_custkey") % 500).cast("string")).alias("path"),
        F.when(st == "F", "completed").when(st == "O", "running").otherwise("failed").alias("status"),
        started.alias("started_at"),
        F.when(st != "O", F.timestamp_add("SECOND", F.floor(F.col("o_totalprice") / 100).cast("bigint"), started)).alias("completed_at"),
        F.floor(F.col("o_totalprice") / 10).alias("files_scanned"), (k % 7).alias("duplicates_found"),
        (k % 100).cast("int").alias("progress_percent"))


def groups_v(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate groups from ``part``, with every status."""
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(
        k.alias("group_id"), F.when(k % 3 == 0, "pending").when(k % 3 == 1, "resolved").otherwise("ignored").alias("status"),
        F.floor(F.col("p_retailprice") * F.col("p_size")).alias("total_size_bytes"),
        F.when(k % 3 == 1, F.floor(F.col("p_retailprice"))).otherwise(0).cast("bigint").alias("saved_bytes"))


def chunks_v(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors from ``embeddings``: two chunks per finding."""
    v = F.col("vec_id")
    return load(spark, sf, "embeddings").select(
        F.floor(v / 2).alias("finding_id"), v.alias("chunk_id"), (v % 2).alias("chunk_index"),
        F.col("embedding").alias("vector"), F.lit("stored").alias("model"), "label")


def review_v(spark: SparkSession, sf: str, findings: int = 997) -> DataFrame:
    """Review events from ``events``. About a third fall on one finding."""
    e, t = F.col("event_id"), F.col("event_type")
    return load(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, F.lit(1)).otherwise(e % findings).cast("bigint").alias("finding_id"),
        F.when(t == "click", "mark_reviewed").when(t == "view", "accept_recommendation")
        .when(t == "purchase", "reject_recommendation").when(t == "signup", "ignore_once")
        .otherwise("create_rule").alias("action"),
        F.when(t.isin("click", "view"), "ignore").otherwise("unignore").alias("ignore_action"), "ts")


def extracted_v(spark: SparkSession, sf: str) -> DataFrame:
    """Extractions from ``conversations``: several per finding."""
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("finding_id"),
        F.col("turn").alias("created_at"), F.col("turn").alias("extracted_id"), "text")


def queries_v(spark: SparkSession, sf: str) -> DataFrame:
    """Natural-language queries from ``supplier`` rows."""
    k, amount = F.col("s_suppkey"), F.floor(F.abs("s_acctbal") / 100 + 1).cast("string")
    month = _nth(["January", "march", "May", "june", "Sept", "December"], F.col("s_nationkey"))
    year = (F.col("s_nationkey") % 3 + 2023).cast("string")
    nation = F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))
    forms = [
        F.concat(F.lit("invoices larger than "), amount, F.lit(" MB from "), month),
        F.concat(F.lit("photos from "), year), F.concat(F.lit("PDFs over "), amount, F.lit(" KB")),
        F.concat(F.lit("large videos smaller than "), amount, F.lit(" GB")),
        F.lit("duplicate installers from last month"),
        F.concat(F.lit("documents mentioning "), nation), F.lit("Word docs from this year safe to delete"),
        F.concat(F.lit("zip files under "), amount, F.lit(" megabytes")), F.concat(F.lit("holiday-"), k.cast("string")),
        F.lit("legal contracts to review from last week"), F.lit("screenshots from yesterday"),
        F.concat(F.lit("huge archives in "), year), F.concat(F.lit("lock files "), amount)]
    return load(spark, sf, "supplier").select(
        k.alias("query_id"), F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("query"))


def projects_v(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects from ``part``, links from ``lineitem``, findings from ``orders``)."""
    k = F.col("p_partkey")
    projects = load(spark, sf, "part").select(
        k.alias("project_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.concat(F.lit("Brand "), F.col("p_brand")).alias("explanation"), F.lit(None).cast("string").alias("summary"),
        F.when(k % 5 == 0, "archived").otherwise("active").alias("status"), (F.col("p_size") / 51.0).alias("confidence"))
    links = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("project_id"),
                                               F.col("l_orderkey").alias("finding_id")).distinct()
    o = F.col("o_orderkey")
    findings = load(spark, sf, "orders").select(
        o.alias("finding_id"), F.concat(_nth(STEMS, o), F.lit("-"), o.cast("string"), _nth(EXTS, o)).alias("name"),
        F.floor("o_totalprice").alias("size_bytes"), F.when(o % 11 != 0, F.col("o_orderpriority")).alias("ai_category"),
        F.when(o % 13 != 0, F.col("o_orderdate").cast("timestamp")).alias("modified_at"))
    return projects, links, findings


def order_entities_v(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of ``orders``: the customer as a person, the nation as an organisation."""
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    j = o.join(c, "o_custkey")
    person = j.select(F.col("o_orderkey").alias("finding_id"), F.lit("person").alias("type"), F.col("c_name").alias("value"))
    org = j.select(F.col("o_orderkey").alias("finding_id"), F.lit("organization").alias("type"),
                   F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("value"))
    return person.unionByName(org)
