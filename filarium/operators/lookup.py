"""Lookup keys for many queries against a table.

Every query gets the keys of one access path, and only rows with one of them are compared with it:
its rarest run of letters for a text, equality keys for categories, extensions and types, and
buckets for ranges of dates and sizes. A key says where a match can be; the full filter decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filarium.operators.skew import join_hot, with_mark
from filarium.session import cut_lineage

RUN = 3
#: Days of a date bucket at each level; a range is cut into the largest buckets that lie in it.
DAY_STEPS = [16 ** n for n in range(6)]
_DAY_ZERO = 1 << 20


def runs_of(text: Column, sizes=(RUN,)) -> Column:
    """Distinct runs of letters of a lower-case text, of each of the sizes."""
    def of(n):
        cut = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes])) if sizes else F.array().cast("array<string>")


def asked_runs(term: Column, size: int = RUN) -> Column:
    """Runs that a match of a LIKE term must hold: the longest of each stretch without wildcards."""
    parts = F.filter(F.split(F.lower(term), "[%_]"), lambda p: F.length(p) > 0)
    longest = F.array_max(F.transform(parts, lambda p: F.least(F.length(p), F.lit(size))))
    cut = F.transform(parts, lambda p: F.when(F.length(p) >= longest, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(p) - longest + 1, F.lit(1))), lambda i: F.substring(p, i, longest)))
        .otherwise(F.array().cast("array<string>")))
    return F.when(F.size(parts) > 0, F.array_distinct(F.flatten(cut))).otherwise(F.array().cast("array<string>"))


def run_sizes(asked: DataFrame, run: str = "run") -> list[int]:
    """Lengths of the runs that queries ask for: at most RUN numbers."""
    return sorted(r[0] for r in asked.select(F.length(run)).distinct().collect())


def rarest_run(asked: DataFrame, rows: DataFrame, texts: list[str], sizes: list[int]) -> DataFrame:
    """(query_id, run): of the runs (query_id, run) of a query the one that the fewest rows hold; no row if none holds it.

    Rows offer only runs that some query asks for, and are counted before the shuffle.
    """
    posts = (rows.select(F.explode(offered_runs(texts, sizes)).alias("run"))
             .join(asked.select("run").distinct(), "run", "left_semi"))
    counts = posts.groupBy("run").agg(F.count("*").alias("n"))
    least = asked.join(counts, "run").groupBy("query_id").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count("*").alias("_have"))
    every = asked.groupBy("query_id").agg(F.count("*").alias("_asked"))
    return least.join(every, "query_id").filter("_have = _asked").select("query_id", "run")


def offered_runs(texts: list[str], sizes: list[int]) -> Column:
    return F.array_distinct(F.flatten(F.array(*[runs_of(F.lower(F.coalesce(F.col(t), F.lit(""))), sizes) for t in texts])))


def meet(rows: DataFrame, offered: Column, asked: DataFrame, row_id: str) -> DataFrame:
    """Rows beside the queries that ask for one of their keys; ``asked`` has a row for each ``_key`` of a query.

    Only keys that are asked for are offered. Rows of a hot key are dealt to sub-keys by a hash of the
    row, so that it is spread over tasks; the queries, far fewer, go to each.
    """
    wanted = asked.select("_key").distinct()

    def posted(*columns):
        # a bitmap drops the keys that nobody asks for before they are shuffled
        posts = with_mark(rows.select(*columns, F.explode(offered).alias("_key")), wanted, ["_key"])
        return posts.filter("_marked").drop("_marked").join(wanted, "_key", "left_semi")

    posts = posted("*")
    sizes = cut_lineage(posted().groupBy("_key").agg(F.count("*").alias("_n")))
    return join_hot(posts, asked, ["_key"], "_n", [row_id], weights=sizes).drop("_key")


def day_of(ts: Column) -> Column:
    """Day number, from 0 on for all dates of the calendar in use; null for null."""
    return F.when(ts.isNotNull(), F.greatest(F.unix_date(F.to_date(ts)).cast("long") + _DAY_ZERO, F.lit(0)))


def day_keys(ts: Column) -> Column:
    """The buckets a date lies in, one for each level; none for null."""
    day = day_of(ts)
    keys = F.array(*[F.concat(F.lit(f"d{n}:"), F.floor(day / step).cast("string")) for n, step in enumerate(DAY_STEPS)])
    return F.when(ts.isNotNull(), keys).otherwise(F.array().cast("array<string>"))


def day_range_keys(start: Column, end: Column) -> Column:
    """The fewest buckets that make up a range of dates; a null bound is open."""
    low = F.coalesce(day_of(start), F.lit(0).cast("long"))
    high = F.coalesce(day_of(end), F.lit(2 * _DAY_ZERO - 1).cast("long"))
    none = F.array().cast("array<string>")
    out = []
    for n, step in enumerate(DAY_STEPS):
        first, last = F.ceil(low / step), F.floor((high + 1) / step) - 1

        def named(a, b, n=n):
            return F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.concat(F.lit(f"d{n}:"), i.cast("string")))).otherwise(none)

        if n + 1 == len(DAY_STEPS):
            out.append(named(first, last))
            continue
        width = DAY_STEPS[n + 1] // step
        up_first, up_last = F.ceil(low / DAY_STEPS[n + 1]) * width, F.floor((high + 1) / DAY_STEPS[n + 1]) * width - 1
        whole = up_first <= up_last  # buckets of the next level lie in the range
        out.append(F.when(whole, F.concat(named(first, up_first - 1), named(up_last + 1, last))).otherwise(named(first, last)))
    return F.concat(*out)


def _size_bucket(size: Column) -> Column:
    """Grows with the size, eight buckets for each doubling."""
    return F.when(size.isNotNull(), F.floor(F.log2(F.greatest(size, F.lit(0)).cast("double") + 1) * 8))


def size_keys(size: Column) -> Column:
    return F.when(size.isNotNull(), F.array(F.concat(F.lit("s:"), _size_bucket(size).cast("string")))).otherwise(F.array().cast("array<string>"))


def size_range_keys(low: Column, high: Column) -> Column:
    """Buckets of a range of sizes; a null bound is open."""
    a = F.coalesce(_size_bucket(low), F.lit(0).cast("long"))
    b = F.coalesce(_size_bucket(high), F.lit(8 * 64).cast("long"))
    return F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.concat(F.lit("s:"), i.cast("string")))).otherwise(
        F.array().cast("array<string>"))
