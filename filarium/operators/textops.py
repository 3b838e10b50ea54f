"""Text analysis: sensitive labels, entities, chunks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filarium import constants as K
from filarium.functions import SPACE_CLASS, java_regex, trim_ws
from filarium.operators.skew import latest
from filarium.sources.files import extract_text


# A text without any of these cannot match the pattern at the same place of the
# list; the plain substring search spares most texts the regular expression.
_SENSITIVE_HINTS = [
    ["agreement", "contract", "plaintiff", "defendant", "whereas", "indemnif", "non-disclosure", "nda"],
    ["routing number", "account number", "iban", "swift code", "bank statement"],
    r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}",
    ["diagnosis", "prescription", "patient", "physician", "medical record", "hipaa"],
    r"\d{3}-\d{2}-\d{4}",
    ["passport number", "social security", "ssn", "license"],
    ["sk-", "api"],
    ["password", "passwd", "pwd"],
    ["PRIVATE KEY"],
]
_ENTITY_HINTS = {
    "invoice_number": ["inv"],
    "case_reference": ["case", "matter", "docket"],
    "amount": ["$"],
    "organization": ["Inc", "LLC", "Ltd", "Corp", "Company", "Co"],
}
# What a match begins with: one look at a character passes over most places, sooner than the look behind.
_ENTITY_FIRST = {
    "date": "(?=[0-9JFMASOND])",
    "invoice_number": "(?=[iI])",
    "case_reference": "(?=[cmdCMD])",
    "organization": "(?=[A-Z])",
    "person": "(?=[A-Z])",
}


def _hinted(text: Column, low: Column, hint, ignore_case: bool) -> Column:
    if isinstance(hint, str):
        return text.rlike(java_regex(hint))
    out = F.lit(False)
    for word in hint:
        out = out | F.contains(low if ignore_case else text, F.lit(word))
    return out


def detect_sensitive(text: Column) -> Column:
    """Distinct sensitive labels in pattern order."""
    low = F.lower(text)
    hits = F.array(*[F.when(_hinted(text, low, hint, ic) & text.rlike(java_regex(p, ic)), F.lit(label))
                     for (label, p, ic), hint in zip(K.SENSITIVE_PATTERNS, _SENSITIVE_HINTS)])
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def entity_arrays(text: Column) -> Column:
    """array<struct(type, value)>: distinct per type, by first occurrence."""
    low, none = F.lower(text), F.array().cast("array<string>")
    found = {}
    for kind, pattern, group, ic in K.ENTITY_PATTERNS:
        raw = F.regexp_extract_all(text, F.lit(_ENTITY_FIRST.get(kind, "") + java_regex(pattern, ic)), F.lit(group))
        # a pattern over all places is faster than a pattern as its hint
        hint = _hinted(text, low, _ENTITY_HINTS[kind], ic) if kind in _ENTITY_HINTS else text.isNotNull()
        raw = F.when(hint, raw).otherwise(none)
        found[kind] = F.array_distinct(F.filter(F.transform(raw, trim_ws), lambda v: v != ""))
    orgs = found["organization"]
    found["person"] = F.filter(found["person"], lambda p: ~F.exists(orgs, lambda o: F.contains(o, p)))

    def typed(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return F.concat(*[typed(kind, values) for kind, values in found.items()])


def extract_entities(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, value) rows (X2, UD4)."""
    # the outer form adds no filter on the array, which would run all patterns again
    return (docs.select(key, F.explode_outer(entity_arrays(F.col("text"))).alias("e"))
            .select(key, "e.type", "e.value").filter("type is not null"))


_SENTENCE = rf"(?<=[.!?]){SPACE_CLASS}+|\n"


def split_sentences(text: Column) -> Column:
    """Trimmed non-empty sentences."""
    return F.filter(F.transform(F.split(text, _SENTENCE), trim_ws), lambda s: s != "")


def split_paragraphs(text: Column) -> Column:
    """Trimmed non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), trim_ws), lambda p: p != "")


def _cut(sentence: Column, least: int) -> Column:
    """A sentence in pieces of CHUNK_MAX characters, those below ``least`` dropped."""
    starts = F.sequence(F.lit(1), F.length(sentence), F.lit(K.CHUNK_MAX))
    pieces = F.transform(starts, lambda i: trim_ws(F.substring(sentence, i, F.lit(K.CHUNK_MAX))))
    return F.filter(pieces, lambda p: F.length(p) >= least)


def _keep(done: Column, piece: Column, least: int) -> Column:
    return F.when(F.length(piece) >= least, F.concat(done, F.array(piece))).otherwise(done)


def pack(paragraph: Column, least: int = 1) -> Column:
    """Greedy packing of a paragraph's sentences into pieces (X6); those below ``least`` characters are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        flushed = _keep(acc["done"], acc["open"], least)
        return (F.when(F.length(joined) <= K.CHUNK_MAX, F.struct(acc["done"].alias("done"), joined.alias("open")))
                .when(F.length(s) > K.CHUNK_MAX,
                      F.struct(F.concat(flushed, _cut(s, least)).alias("done"), F.lit("").alias("open")))
                .otherwise(F.struct(flushed.alias("done"), s.alias("open"))))

    packed = F.aggregate(split_sentences(paragraph), start, step, lambda acc: _keep(acc["done"], acc["open"], least))
    return F.when(F.length(paragraph) <= K.CHUNK_MAX, F.array(paragraph)).otherwise(packed)


def with_overlap(pieces: Column, lossless: bool = True) -> Column:
    """Prefix each piece with the end of the one before it.

    The prefix takes the room that the piece leaves; without ``lossless`` it always has its
    full length, and the end of the piece is cut.
    """
    before = F.transform(F.concat(F.array(F.lit("")), F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))),
                         lambda p: F.right(p, F.lit(K.CHUNK_OVERLAP)))

    def fitting(b: Column, p: Column) -> Column:
        return F.right(b, F.greatest(F.lit(K.CHUNK_MAX - 1) - F.length(p), F.lit(0))) if lossless else b

    joined = F.zip_with(before, pieces, lambda b, p: F.when(b == "", p).otherwise(F.concat(fitting(b, p), F.lit(" "), p)))
    return F.transform(joined, lambda t: F.substring(trim_ws(t), 1, K.CHUNK_MAX))


def chunk_text(docs: DataFrame, key: str = "doc_id", lossless: bool = True) -> DataFrame:
    """(key, chunk_index, chunk_text) rows of the whole text.

    Every word of a text is in a chunk. Without ``lossless`` pieces below CHUNK_MIN characters are
    dropped and long pieces lose their end to the overlap; the index is the position of the raw
    piece, so dropped ones leave gaps.
    """
    least = 1 if lossless else K.CHUNK_MIN
    keep = [key] + [c for c in ("extracted_id",) if c in docs.columns]
    pieces = F.flatten(F.transform(split_paragraphs(F.col("text")), lambda p: pack(p, least)))
    staged = docs.select(*keep, pieces.alias("_pieces"))
    # outer for the same reason; texts without pieces drop out by their length
    return (staged.select(*keep, F.posexplode_outer(with_overlap(F.col("_pieces"), lossless)).alias("chunk_index", "chunk_text"))
            .filter(F.length("chunk_text") >= least))


def rank_ratio(text: Column, query: Column) -> Column:
    """Share of the chunk's tokens that are query tokens of three or more characters."""
    wanted = F.filter(F.split(F.lower(query), SPACE_CLASS + "+"), lambda t: F.length(t) >= 3)
    tokens = F.split(F.lower(text), SPACE_CLASS + "+")
    return F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t))) / F.greatest(F.size(tokens), F.lit(1))


def top_chunks(chunks: DataFrame, n: int = 3, by: list[str] = ("doc_id", "query_id")) -> DataFrame:
    """Best ``n`` chunks per document and query.

    ``chunks`` has chunk_index, chunk_text and query. The rank filter is applied
    before the shuffle as well as after it.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_index")
    return (chunks.withColumn("score", rank_ratio(F.col("chunk_text"), F.col("query")))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))


def summary_of(text: Column) -> Column:
    """First two sentences, at most 500 characters."""
    parts = F.filter(F.split(text, rf"(?<=[.!?]){SPACE_CLASS}+"), lambda s: s != "")
    out = F.substring(F.array_join(F.slice(parts, 1, 2), " "), 1, 500)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(K.SUMMARY_EMPTY))


def latest_extraction(extracted: DataFrame, key: str = "finding_id") -> DataFrame:
    """Newest extraction per finding."""
    return latest(extracted, [key], ["created_at", "extracted_id"])


def summarize(extracted: DataFrame, key: str = "finding_id") -> DataFrame:
    """Summary of the newest extraction per finding."""
    # summarise first, so that only the short text is shuffled
    short = extracted.select(key, "created_at", "extracted_id", summary_of(F.col("text")).alias("summary"))
    return latest(short, [key], ["created_at", "extracted_id"]).select(
        key, "summary", F.lit("local-extractive").alias("provider"))


def extraction_job(files: DataFrame) -> DataFrame:
    """Text, labels and entities of every file in one pass.

    Files that cannot be read stay in the result with a reason.
    """
    done = extract_text(files)
    return (done
            .withColumn("sensitive_categories", detect_sensitive(F.col("text")))
            .withColumn("entities", entity_arrays(F.col("text")))
            .withColumn("skip_reason", F.when(F.col("extractor").isNull(), "no extractor for this file type")))

