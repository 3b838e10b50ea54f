"""Rule classifier (C7-C12, J16, UD1).

One ordered CASE yields a rule index; everything else about the result is read
from a constant array of rule structs, so the branches are evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filarium import constants as K
from filarium.functions import (any_pattern, first_keyword, first_segment_keyword, half_up_div, parent,
                                sql_literal)
from filarium.operators import rules as R
from filarium.operators.skew import join_hot

AI_SCHEMA = ("struct<rule:string,keyword:string,category:string,subcategory:string,confidence:int,"
             "explanation:string,tags:array<string>,suggested_destination:string,"
             "suggested_action:string,recommendation:struct<action:string,reason:string,"
             "safe:boolean,reversible:boolean,requires_confirmation:boolean>,provider:string>")


def _rule_table() -> list[tuple]:
    table = list(R.RULES)
    for topic, category, with_ext, no_ext, dest in K.DOCUMENT_TOPICS:
        common = (dest, R.TOPIC_ACTION.format(destination=dest), "keep",
                  R.TOPIC_REASON.format(category=category), True)
        tags = [category.lower().replace(" ", "-"), "document", "{kw}"]
        for key, conf, text in ((f"{topic}_document", with_ext, R.TOPIC_EXPLANATION),
                                (f"{topic}_no_extension", no_ext, R.TOPIC_EXPLANATION_NO_EXT)):
            table.append((key, category, None, conf, *common,
                          text.replace("{category}", category.lower()), tags))
    return table


RULE_TABLE = _rule_table()
RULE_INDEX = {row[0]: i + 1 for i, row in enumerate(RULE_TABLE)}


# Keywords to name in the result: rule -> (list for the file name, list for folders).
_NAMED_KEYWORDS = {
    "web_folder": ([], K.FOLDER_KEYWORDS["web"]),
    "branding": (K.NAME_KEYWORDS["branding"], K.NAME_KEYWORDS["branding"]),
    "design_folder": ([], K.FOLDER_KEYWORDS["design"]),
    "design_document": ([], K.FOLDER_KEYWORDS["design"]),
    "photo_folder": ([], K.FOLDER_KEYWORDS["photo"]),
    "photo_hint": ([], K.FOLDER_KEYWORDS["photo"]),
    "video_hint": ([], K.FOLDER_KEYWORDS["video"]),
    "audio_hint": ([], K.FOLDER_KEYWORDS["audio"]),
    **{f"{topic}_{form}": (K.NAME_KEYWORDS[topic], K.FOLDER_KEYWORDS[topic] if topic in K.FOLDER_KEYWORDS else [])
       for topic, *_ in K.DOCUMENT_TOPICS for form in ("document", "no_extension")},
}


def _rule_structs() -> Column:
    """The rule table as one constant array of structs."""
    fields = ["key", "category", "subcategory", "confidence", "destination", "suggested_action", "action",
              "reason", "safe", "explanation", "tags", "name_keywords", "folder_keywords"]
    rows = [(*row, *_NAMED_KEYWORDS.get(row[0], ([], []))) for row in RULE_TABLE]
    structs = ("named_struct(" + ", ".join(f"'{f}', {sql_literal(v)}" for f, v in zip(fields, row)) + ")" for row in rows)
    return F.expr("array(" + ", ".join(structs) + ")")


def _with_parts(df: DataFrame) -> DataFrame:
    """Working columns: lower-case name, extension and folder text."""
    folder = F.regexp_extract(F.rtrim(F.translate(F.lower("path"), "\\", "/"), F.lit("/")), r"(?s)^(.*)/[^/]*$", 1)
    return (df.withColumn("_name", F.lower("name"))
            .withColumn("_ext", F.lower("extension"))
            .withColumn("_dir", folder))


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(sql_literal, values))})"


def _contains(column: str, keywords) -> str:
    return f"{column} RLIKE {sql_literal(any_pattern(keywords))}"


def rule_id() -> Column:
    """Ordered CASE over the working columns; value is a 1-based rule index.

    Written as SQL text and parsed once: as Column calls it takes over a thousand.
    """
    def ext(values):
        return _one_of("_ext", values)

    inside = {t: _contains("_dir", kws) for t, kws in K.FOLDER_KEYWORDS.items()}
    named = {t: _contains("_name", kws) for t, kws in K.NAME_KEYWORDS.items()}
    web_file = f"({_one_of('_name', K.WEB_NAMES)} OR {ext(K.WEB_EXTS)})"
    brand = f"({named['branding']} OR {_contains('_dir', K.NAME_KEYWORDS['branding'])})"

    steps = [
        ("finding_type = 'duplicate'", "duplicate"),
        ("finding_type = 'idlk_file'", "lock_indesign"),
        (f"{ext(K.LOCK_EXTS)} OR endswith(_name, '.lock')", "lock_application"),
        ("finding_type = 'locked_file'", "locked"),
        (f"{ext(K.IMAGE_EXTS)} AND _name RLIKE {sql_literal(K.SCREENSHOT_PREFIX)}", "screenshot"),
        ("finding_type = 'zero_byte'", "zero_byte"),
        ("finding_type = 'empty_folder'", "empty_folder"),
        ("finding_type = 'installer'", "installer"),
        ("finding_type = 'archive'", "archive"),
        (ext(K.TEMP_EXTS), "temporary"),
        ("_ext = '.log' AND (contains(_name, 'log') OR concat(_dir, '/') RLIKE '/logs?/')", "log"),
        (f"{web_file} AND {inside['web']}", "web_folder"),
        (web_file, "web"),
        ("_ext = '.zip' AND beside_project", "web_zip"),
        (f"{ext(K.VECTOR_EXTS)} AND {brand}", "branding"),
        (f"{ext(K.DESIGN_EXTS)} AND {inside['design']}", "design_folder"),
        (ext(K.DESIGN_EXTS), "design"),
        (f"{ext(K.DOC_EXTS)} AND {inside['design']}", "design_document"),
        (ext(K.RAW_EXTS), "photo_raw"),
        (f"{ext(K.IMAGE_EXTS)} AND {inside['photo']}", "photo_folder"),
        (ext(K.IMAGE_EXTS), "photo"),
        (ext(K.VIDEO_EXTS), "video"),
        (ext(K.AUDIO_EXTS), "audio"),
        (ext(K.CODE_EXTS), "code"),
    ]
    for topic, *_ in K.DOCUMENT_TOPICS:
        hit = f"({named[topic]} OR {inside[topic]})" if topic in inside else named[topic]
        steps += [(f"{ext(K.DOC_EXTS + K.SHEET_EXTS)} AND {hit}", f"{topic}_document"),
                  (f"_ext = '' AND {hit}", f"{topic}_no_extension")]
    steps += [
        (inside["video"], "video_hint"),
        (inside["audio"], "audio_hint"),
        (inside["photo"], "photo_hint"),
        (f"finding_type = 'large_file' AND {ext(K.VIDEO_EXTS + K.DISK_IMAGE_EXTS)}", "large_image"),
        ("finding_type = 'large_file'", "large"),
    ]
    whens = " ".join(f"WHEN {cond} THEN {RULE_INDEX[key]}" for cond, key in steps)
    return F.expr(f"CASE {whens} ELSE {RULE_INDEX['unknown']} END")


def _keyword(rule: Column) -> Column:
    """The keyword that fired, from the lists of the chosen rule."""
    return F.coalesce(first_keyword(F.col("_name"), rule["name_keywords"]),
                      first_segment_keyword(F.split("_dir", "/"), rule["folder_keywords"]))


def _let(value: Column, use) -> Column:
    """Bind a value to a lambda variable, so that it is computed once per row and
    not once for every place where the optimizer would copy it to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _result(r: Column, kw: Column) -> Column:
    """Classification struct of rule struct ``r`` and keyword ``kw``."""
    ext = F.col("_ext")
    shown = F.coalesce(F.nullif(ext, F.lit("")), F.lit("no extension"))
    why = F.call_function("format_string", r["explanation"], ext, F.col("name"),
                          half_up_div(F.col("size_bytes"), 1048576), F.coalesce(kw, F.lit("")),
                          F.coalesce(F.nullif(ext, F.lit("")), F.col("_name")), shown)
    no_dot = F.regexp_replace(ext, r"^([^.]*)\.", "$1")
    tags = F.transform(r["tags"], lambda t: F.when(t == "{ext}", no_dot).when(t == "{kw}", kw).otherwise(t))
    return F.struct(
        r["key"].alias("rule"), kw.alias("keyword"), r["category"].alias("category"),
        r["subcategory"].alias("subcategory"),
        F.least(F.lit(100), F.greatest(F.lit(0), r["confidence"])).alias("confidence"),
        why.alias("explanation"), tags.alias("tags"),
        r["destination"].alias("suggested_destination"), r["suggested_action"].alias("suggested_action"),
        F.struct(r["action"].alias("action"), r["reason"].alias("reason"), r["safe"].alias("safe"),
                 (r["action"] != "delete").alias("reversible"),
                 F.lit(True).alias("requires_confirmation")).alias("recommendation"),
        F.lit("local-rule").alias("provider"))


def classify(df: DataFrame) -> DataFrame:
    """Add ``ai``, the classification struct.

    Needs path, name, extension, size_bytes and finding_type (null for none).
    ``beside_project`` (see :func:`beside_project`) is taken as false if absent.
    """
    if "beside_project" not in df.columns:
        df = df.withColumn("beside_project", F.lit(False))
    keep = [c for c in df.columns if c != "beside_project"]
    ai = _let(F.element_at(_rule_structs(), rule_id()), lambda r: _let(_keyword(r), lambda kw: _result(r, kw)))
    return _with_parts(df).select(*keep, ai.alias("ai"))


def beside_project(entries: DataFrame) -> DataFrame:
    """Add ``beside_project``: the folder also holds a manifest or source folder.

    Only the yes/no answer per folder is needed, so sibling names are never
    gathered into one row.
    """
    keyed = entries.withColumn("_parent", parent(F.lower("path")))
    folders = (keyed.groupBy("_parent")
               .agg(F.count("*").alias("_n"),
                    F.bool_or(F.lower("name").isin(K.WEB_NEIGHBOURS)).alias("beside_project"))
               .filter("beside_project"))
    return (join_hot(keyed, folders, ["_parent"], "_n", ["path"], "left")
            .withColumn("beside_project", F.coalesce("beside_project", F.lit(False)))
            .drop("_parent", "_n"))


def classify_with(df: DataFrame, model: Column) -> DataFrame:
    """Model result where there is one, else the rules marked as fallback (C11, UD1).

    ``model`` is a column of type AI_SCHEMA, for example a pandas UDF, that is
    null where the model failed.
    """
    ruled = classify(df)
    fallback = F.col("ai").withField("provider", F.concat("ai.provider", F.lit("(fallback)")))
    return ruled.withColumn("ai", F.coalesce(model.cast(AI_SCHEMA), fallback))


def semantic_tags(classified: DataFrame, key: str = "finding_id") -> DataFrame:
    """Distinct (key, tag) rows (C12). Tags sit in one row, so no shuffle is needed."""
    # the outer form adds no filter on the array, which would compute it again
    return classified.select(key, F.explode_outer(F.array_distinct("ai.tags")).alias("tag")).filter("tag is not null")
