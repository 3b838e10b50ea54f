"""Natural-language query interpretation over a table of queries (X11)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from filarium import constants as K
from filarium.functions import (any_pattern, approx_bytes, capitalise, java_regex, lookup, parse_number,
                                slug, sql_literal, strings, trim_ws, words)


def _matches(q: Column, pattern: str) -> Column:
    return q.rlike(java_regex(pattern))


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _flat(*items: Column) -> Column:
    """Concatenate the arrays that are not null."""
    return F.flatten(F.filter(F.array(*items), lambda x: x.isNotNull()))


def _named_hits(q: str, pairs) -> Column:
    """Names whose pattern occurs in column ``q``, in list order; parsed as one expression."""
    cases = ", ".join(f"CASE WHEN {q} RLIKE {sql_literal(p)} THEN {sql_literal(v)} END" for v, p in pairs)
    return F.expr(f"filter(array({cases}), x -> x IS NOT NULL)")


def categories(q: str) -> Column:
    """Categories with a synonym in the text, in list order."""
    return _named_hits(q, [(cat, any_pattern(kws)) for cat, kws in K.QUERY_CATEGORIES])


def finding_types(q: str) -> Column:
    """Finding types named in the text."""
    return _named_hits(q, [(t, any_pattern(kws)) for t, kws in K.QUERY_TYPES])


def statuses(q: str) -> Column:
    """Statuses named in the text."""
    return _named_hits(q, [(s, java_regex(p)) for s, p in K.QUERY_STATUSES])


def _unit_bytes(unit: Column) -> Column:
    power = lookup(F.substring(unit, 1, 1), {"b": 0, "k": 1, "m": 2, "g": 3, "t": 4})
    return F.pow(F.lit(1024.0), power)


def _bound(q: Column, pattern: str) -> Column:
    rx = java_regex(pattern)
    size = parse_number(F.regexp_extract(q, rx, 1)) * _unit_bytes(F.regexp_extract(q, rx, 2))
    return F.floor(size + 0.5).cast("bigint")


def size_bounds(q: Column) -> tuple[Column, Column]:
    """Smallest and largest size asked for (X11d)."""
    explicit = F.greatest(*[_bound(q, p) for p in K.SIZE_MIN_PATTERNS])
    vague = F.greatest(*[F.when(_matches(q, p), F.lit(b).cast("bigint")) for p, b in K.SIZE_WORDS])
    return F.coalesce(explicit, vague), F.least(*[_bound(q, p) for p in K.SIZE_MAX_PATTERNS])


def extension_labels(q: str) -> Column:
    """Labels of the extension shortcuts that apply (X11e)."""
    return _named_hits(q, [(label, java_regex(p)) for p, _, label in K.QUERY_EXTENSIONS])


def extensions(q: str) -> Column:
    """Distinct extensions of those shortcuts (X11e)."""
    return F.array_distinct(F.flatten(_named_hits(q, [(exts, java_regex(p)) for p, exts, _ in K.QUERY_EXTENSIONS])))


def date_range(q: Column, now: Column) -> Column:
    """Struct(date_from, date_to, label): first date expression by precedence (X11f)."""
    today = F.to_date(now)
    year, week = F.year(now), F.to_date(F.date_trunc("week", now))
    month = F.to_date(F.date_trunc("month", now))
    this_year = F.make_date(year, F.lit(1), F.lit(1))

    def span(first: Column, last: Column, label: Column) -> Column:
        end = last.cast("timestamp") + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")
        return F.struct(first.cast("timestamp").alias("date_from"), end.alias("date_to"), label.alias("label"))

    def whole_year(y: Column) -> Column:
        return span(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)), y.cast("string"))

    named_year = F.regexp_extract(q, java_regex(r"\b(?:in|from|during)?\s*(20\d{2}|19\d{2})\b"), 1)
    word = F.regexp_extract(q, java_regex(rf"\b(?:from|in|during)?\s*({K.MONTH_PATTERN})\b"), 1)
    number = lookup(F.substring(word, 1, 3), {m[:3]: i for i, m in enumerate(K.MONTH_WORDS, start=1)})
    month_year = F.when(number > F.month(now), year - 1).otherwise(year)
    month_start = F.make_date(month_year, number, F.lit(1))

    return (F.when(_matches(q, r"\blast\s+week\b"), span(F.date_sub(week, 7), F.date_sub(week, 1), F.lit("last week")))
            .when(_matches(q, r"\bthis\s+week\b"), span(week, today, F.lit("this week")))
            .when(_matches(q, r"\blast\s+month\b"),
                  span(F.add_months(month, -1), F.date_sub(month, 1), F.lit("last month")))
            .when(_matches(q, r"\bthis\s+month\b"), span(month, today, F.lit("this month")))
            .when(_matches(q, r"\blast\s+year\b"), whole_year(year - 1))
            .when(_matches(q, r"\bthis\s+year\b"), span(this_year, today, year.cast("string")))
            .when(named_year != "", whole_year(F.nullif(named_year, F.lit("")).cast("int")))
            .when(word != "", span(month_start, F.last_day(month_start),
                                   F.concat(capitalise(word), F.lit(" "), month_year.cast("string"))))
            .when(_matches(q, r"\btoday\b"), span(today, today, F.lit("today")))
            .when(_matches(q, r"\byesterday\b"), span(F.date_sub(today, 1), F.date_sub(today, 1), F.lit("yesterday"))))


def mention(query: Column) -> Column:
    """Name the query asks about, in its original case (X11g)."""
    text = trim_ws(query)
    found = [F.nullif(trim_ws(F.regexp_extract(text, java_regex(pattern, True).replace("|$)", r"|\z)"), 1)),
                      F.lit("")) for pattern in K.MENTION_PATTERNS]
    return F.coalesce(*found)


def interpret_queries(queries: DataFrame, now: datetime | Column) -> DataFrame:
    """Add the interpretation of each ``query`` as columns (X11).

    ``now`` is the reference time for relative dates.
    """
    if not isinstance(now, Column):
        now = F.lit(now)
    base = queries.withColumn("_q", F.lower(trim_ws(F.col("query")))).withColumn("_words", words(F.col("_q")))
    q = F.col("_q")
    low, high = size_bounds(q)
    df = base.withColumns({
        "categories": categories("_q"), "finding_types": finding_types("_q"), "statuses": statuses("_q"),
        "min_size_bytes": low, "max_size_bytes": high, "extensions": extensions("_q"),
        "_ext_labels": extension_labels("_q"), "_d": date_range(q, now), "mentioned_entity": mention(F.col("query"))})
    df = df.withColumns({"tags": F.transform("categories", slug), "date_from": F.col("_d.date_from"),
                         "date_to": F.col("_d.date_to"), "date_label": F.col("_d.label")})
    df = df.withColumns({"applied_filters": _applied(), "explanation": _explanation(), "confidence": _confidence(),
                         "unrecognized_terms": _unrecognised()})
    return df.drop("_q", "_words", "_ext_labels", "_d")


def _confidence() -> Column:
    """Share of words explained by signals (X11h)."""
    signals = reduce(lambda a, b: a + b, [F.size(c) for c in ("categories", "finding_types", "statuses", "_ext_labels")])
    for c in ("min_size_bytes", "max_size_bytes", "date_label", "mentioned_entity"):
        signals = signals + F.col(c).isNotNull().cast("int")
    return F.round(F.least(signals / F.greatest(F.size("_words"), F.lit(1)), F.lit(1.0)), 2)


def _applied() -> Column:
    """array<struct(label, value, source)> (X11j)."""
    def chip(label, value, source):
        return F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(source).alias("source"))

    def chips(label, values, source, change=lambda v: v):
        return F.transform(values, lambda v: chip(label, change(v), source))

    def single(column, label, value, source):
        return F.when(F.col(column).isNotNull(), F.array(chip(label, value, source)))

    return _flat(
        chips("Category", F.col("categories"), "category"),
        chips("Status", F.col("statuses"), "status", lambda v: F.translate(v, "_", " ")),
        single("min_size_bytes", "Min size", F.concat(F.lit("≥ "), approx_bytes(F.col("min_size_bytes"))), "size"),
        single("max_size_bytes", "Max size", F.concat(F.lit("≤ "), approx_bytes(F.col("max_size_bytes"))), "size"),
        chips("Extension", F.col("_ext_labels"), "extension"),
        single("date_label", "Date", F.col("date_label"), "date"),
        single("mentioned_entity", "Mentions", F.col("mentioned_entity"), "entity"))


def _explanation() -> Column:
    def listed(word, column):
        return F.when(F.size(column) > 0, F.concat(F.lit(word + ' "'), F.array_join(column, " or "), F.lit('"')))

    def sized(sign, column):
        return F.when(F.col(column) > 0, F.concat(F.lit(f"size {sign} "), approx_bytes(F.col(column))))

    parts = _present(
        listed("category", "categories"), listed("type", "finding_types"), listed("status", "statuses"),
        sized("≥", "min_size_bytes"), sized("≤", "max_size_bytes"),
        F.concat(F.lit("extension ."), F.get("extensions", F.lit(0))),
        F.concat(F.lit("modified "), F.col("date_label")),
        F.concat(F.lit('entity "'), F.col("mentioned_entity"), F.lit('"')))
    understood = F.concat(F.lit("Interpreted as: "), F.array_join(parts, ", "),
                          F.lit(". Falling back to plain text match for any remaining words."))
    plain = F.concat(F.lit('No category, status, or size keywords recognised — using "'), F.col("query"),
                     F.lit('" as a plain text search.'))
    return F.when(F.size(parts) > 0, understood).otherwise(plain)


def _unrecognised() -> Column:
    """Words of three or more characters that nothing accounts for (X11i)."""
    def split_all(phrases):
        return sorted({w for p in phrases for w in p.split()})

    known = strings(sorted(set(K.QUERY_FILLERS) | set(split_all(k for _, ks in K.QUERY_TYPES for k in ks))))
    by_category = [F.when(F.array_contains("categories", cat), strings(split_all(kws)))
                   for cat, kws in K.QUERY_CATEGORIES]
    sized = (F.coalesce("min_size_bytes", F.lit(0)) > 0) | (F.coalesce("max_size_bytes", F.lit(0)) > 0)
    matched = _flat(
        known, *by_category,
        F.when(F.col("date_label").isNotNull(), strings(K.QUERY_DATE_WORDS)),
        F.when(F.col("mentioned_entity").isNotNull(), strings(K.QUERY_MENTION_WORDS)),
        words(F.lower("mentioned_entity")),
        F.when(sized, strings(K.QUERY_SIZE_WORDS)))
    return F.filter("_words", lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~F.array_contains(matched, w))
