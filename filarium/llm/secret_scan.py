"""Secret scan: patterns find candidates, a random forest removes false positives.

A finding is a long run of key characters with a digit, a public token format, or the value of an
assignment: in a word that holds such a run or a credential name before a sign, every one of them, and
after a credential name also where blanks or quotes stand around the sign. Its features are length, character transitions, the share of its
letters that lies in dictionary words, its path and the neighbouring words. The dictionary is the
most frequent words of all documents, a table of fixed size. The forest is fitted to labelled
findings; of these at most ``FIT_ROWS`` are used, chosen by hash. Only built-in functions and the
forest of Spark ML run.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, words_of

FIT_ROWS = 50_000
DICTIONARY = 4000
TREES, DEPTH = 24, 6

# Public token formats, credential names, placeholders and test paths.
FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"
NAMES = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"
PLACEHOLDERS = r"(?i)(example|sample|dummy|changeme|your[_-]|placeholder|xxxx|\*\*\*|redacted)"
TEST_PATHS = r"(?i)(test|spec|fixture|mock|sample|example|docs?)(/|_|-|\.|$)"

#: A run of key characters; only runs with a digit count. It starts where no such run goes on, so long runs are read once.
RUN = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9])[A-Za-z0-9_+/=.-]{12,}"
#: The value of an assignment within a word, and one to a credential name.
SET = r"[\"']?[=:][\"']?([^\"'\s]{6,})"
VALUE = r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)" + SET
NAMED = NAMES + r"[A-Za-z0-9_-]*" + SET
#: A word is cut before the next assignment in it.
CUT = r"[,;&?|{}\[\]()<>](?=[\"']?[A-Za-z0-9_.-]++[\"']?[=:])"
#: A credential name (not an author), the same with a sign behind it, and an assignment with blanks around the sign.
NAME_END = NAMES + r"(?<!(?i:auth)(?=(?i:or(?!iz))))[A-Za-z0-9_-]*[\"']?"
SIGN_END = NAME_END + r"\s?[=:]>?[\"']?$"
SPACED = NAME_END + r"(?:\s*[=:]>?\s+|\s+[=:]>?)[\"']?[^\"'\s]{6}"
#: Characters of a word and of its neighbours that a finding carries along.
AROUND = 300
FEATURES = ["length", "digit_share", "upper_share", "hex_share", "letter_digit_turns", "case_turns", "vowel_turns",
            "distinct_share", "coverage", "dots", "at_sign", "assigned", "named_before", "named_after", "placeholder",
            "known_format", "test_path", "path_depth"]


def findings(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, path, place, word, before, after, value): candidates of every whole text.

    ``place`` is the word's number in its text, ``word`` the part of it with the value, ``before`` the
    three words before it, ``after`` the next one, each cut to AROUND characters. ``path`` is the documents'
    source, null without that column. Null texts have no findings.
    """
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    some = docs.select("doc_id", path.cast("string").alias("path"), "text", F.col("text").rlike(SPACED).alias("spaced")).where(
        F.col("text").rlike(RUN) | F.col("text").rlike(NAMED) | F.col("spaced"))
    words = some.select("doc_id", "path", "spaced", words_of(F.col("text")).alias("words"))
    lead = lambda i: F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1))
    starts = lambda w, i: (lead(i).rlike(SIGN_END) & w.rlike(r"^[\"']?[^\"'\s]{6}")) | (
        w.rlike(r"^[=:]>?[\"']?[^\"'\s]{6}") & lead(i).rlike(NAME_END + "$"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(
        i.alias("place"), w.alias("word"), F.when(F.col("spaced"), starts(w, i)).otherwise(False).alias("set"))),
        lambda p: p["word"].rlike(RUN) | p["word"].rlike(NAMED) | p["set"])
    # explode_outer: for explode a filter on the hits would be pushed below, which splits the text anew for every word
    found = words.select("doc_id", "path", "words", hits.alias("hits")).select("doc_id", "path", "words", F.explode_outer("hits").alias("hit")).where("hit is not null")
    at = F.col("hit.place")
    first = F.greatest(at - 3, F.lit(0))
    found = found.select("doc_id", "path", at.alias("place"), F.col("hit.word").alias("w"), F.col("hit.set").alias("set"),
                         F.right(F.array_join(F.slice("words", first + 1, at - first), " "), F.lit(AROUND)).alias("before"),
                         F.left(F.coalesce(F.get("words", at + 1), F.lit("")), F.lit(AROUND)).alias("after"))
    every = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    tails = r"^[=/.+-]+|(?<![=.,;:!?)\]}+/-])[=.,;:!?)\]}+/-]+$"
    trim = lambda v: F.when(F.length(F.regexp_replace(v, tails, "")) >= 6, F.regexp_replace(v, tails, "")).otherwise(v)
    held = lambda word, values: F.transform(values, lambda v: F.struct(F.left(word, F.lit(AROUND)).alias("word"), v.alias("value")))
    parts = F.transform(F.split("w", CUT), lambda p: held(p, F.array_distinct(F.transform(F.concat(
        every(p, VALUE, 2), every(p, FORMATS, 0),
        # runs outside the values
        every(F.regexp_replace(p, VALUE, "$1 "), "(" + RUN + ")", 1)), trim))))
    spaced = F.when(F.col("set"), F.array(F.regexp_extract("w", r"^(?:[=:]>?)?[\"']?([^\"'\s]{6,})", 1))).otherwise(F.array().cast("array<string>"))
    found = found.withColumns({"parts": F.flatten(parts), "more": F.transform(F.concat(every(F.col("w"), NAMED, 3), spaced), trim)})
    more = held(F.col("w"), F.array_except("more", F.col("parts.value")))  # without what a part of the word has already
    found = found.withColumn("v", F.explode(F.concat("parts", more)))
    return found.select("doc_id", "path", "place", F.col("v.word").alias("word"), "before", "after",
                        F.col("v.value").alias("value")).where("value <> ''")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The most frequent lower-cased words of three letters or more, over all documents."""
    words = docs.select(F.explode(words_of(F.lower("text"))).alias("w")).select(F.regexp_extract("w", r"^(\p{L}{3,20})[.,;:!?]?$", 1).alias("w"))
    return words.where("w <> ''").groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(size).select("w")


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES; ``known`` is a table of at most DICTIONARY words."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    assigned = F.col("word").rlike(VALUE) | F.col("word").rlike("^[=:]") | F.col("before").rlike(r"[=:]>?[\"']?$")
    words = known.agg(F.collect_list("w").alias("known"))
    parts = F.filter(F.split(F.lower(F.regexp_replace("value", r"([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+"), lambda p: F.length(p) >= 3)
    out = found.crossJoin(F.broadcast(words))  # one row of bounded size
    return out.withColumns({
        "length": n.cast("double"), "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "hex_share": share("[0-9a-f]"),
        "letter_digit_turns": share("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"), "case_turns": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "vowel_turns": share("(?<=[aeiouAEIOU])[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]|(?<=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])[aeiouAEIOU]"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "coverage": F.aggregate(F.filter(parts, lambda p: F.array_contains("known", p)), F.lit(0), lambda s, p: s + F.length(p)) / n,
        "dots": share("[.]"), "at_sign": flag(F.col("word").contains("@")), "assigned": flag(assigned),
        "named_before": flag(F.concat_ws(" ", "before", F.regexp_extract("word", r"^([^=:]*)[=:]", 1)).rlike(NAMES)),
        "named_after": flag(F.col("after").rlike(NAMES)),
        "placeholder": flag(F.concat_ws(" ", "before", "word", "after").rlike(PLACEHOLDERS)),
        "known_format": flag(v.rlike(FORMATS)), "test_path": flag(F.col("path").rlike(TEST_PATHS)),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
    }).drop("known")


def evident(found: DataFrame) -> Column:
    """Label of a finding from evidence: 1 a known format or a named assignment, 0 a number, address or host, else null."""
    named = F.concat_ws(" ", "before", F.regexp_extract("word", r"^([^=:]*)[=:]", 1)).rlike(NAMES)
    assigned = F.col("word").rlike(VALUE) | F.col("word").rlike("^[=:]") | F.col("before").rlike(r"[=:]>?[\"']?$")
    dull = (F.col("word").rlike(r"@|://|^www\.") | F.col("value").rlike(r"^[0-9.+()/:-]+$")
            | F.concat_ws(" ", "before", "word", "after").rlike(PLACEHOLDERS) | F.col("path").rlike(TEST_PATHS))
    # words of prose after a colon: known ones are negatives, others tell nothing
    prose = F.col("before").rlike(r"[=:]>?[\"']?$") & F.col("value").rlike(r"^\p{L}+$")
    return (F.when(F.coalesce(dull, F.lit(False)), 0.0).when(F.col("value").rlike(FORMATS), 1.0)
            .when(prose, F.when(F.col("coverage") > 0.999, 0.0)).when(named & assigned, 1.0))


def fit(labelled: DataFrame, label: str = "label", rows: int = FIT_ROWS):
    """A forest over featured findings with a label of 0 or 1; None if one of the two is missing."""
    known = labelled.where(F.col(label).isNotNull())
    sample = stored(known.select(*FEATURES, F.col(label).cast("double").alias("label"),
                                 F.xxhash64("doc_id", "place", "value").alias("h")).orderBy("h", *FEATURES).limit(rows), "labelled")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def scored(found: DataFrame, forest) -> DataFrame:
    """Adds ``score`` and ``is_secret``; without a forest every finding counts as a secret."""
    if forest is None:
        return found.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    wide = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    out = forest.transform(wide).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return out.withColumn("is_secret", F.col("score") >= 0.5).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Findings with score and is_secret.

    The forest learns from the findings in documents that ``labels`` covers (all documents if
    none are given), as far as their evidence decides; it judges every finding.
    """
    found = stored(featured(findings(docs), dictionary(docs)), "findings")
    known = found
    if labels is not None:
        known = found.join(labels.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    return scored(found, fit(known.withColumn("label", evident(known))))


def redact(docs: DataFrame, labels: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """Documents with the values of their secrets replaced, with all their columns; ``n_chars`` follows."""
    found = scan(docs, labels).where("is_secret")
    # longer values first, so that none is replaced in part
    secrets = found.groupBy("doc_id").agg(F.collect_set(F.struct((-F.length("value")).alias("l"), "value")).alias("s")).select(
        F.col("doc_id").alias("id"), F.col("s").alias("secrets"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    wide = row.join(secrets, F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    clean = F.aggregate(F.sort_array("secrets"), F.col("row.text"), lambda t, s: F.replace(t, s["value"], F.lit(mark)))
    wide = wide.select("row", "id", F.when(F.col("id").isNull(), F.col("row.text")).otherwise(clean).alias("text"))
    return wide.select(*[
        F.col("text") if c == "text" else
        F.when(F.col("id").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars") if c == "n_chars"
        else F.col(f"row.`{c}`") for c in docs.columns])
