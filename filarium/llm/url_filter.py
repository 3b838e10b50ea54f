"""URL filter: fixed rules first, then a path-template tree per host with smoothed labelled purity.

Urls are counted per host and path segments before any other shuffle. The tree then grows level by
level from each host, as deep as the paths go: a node stays open while its labels are mixed, and
segments that all its paths share are passed in one step. Segments are literal until the counts say
that they vary: where a node has many children with few urls each, these become one wildcard. Each
child is held against its siblings by a two-proportion test. One that differs is judged by its own
counts; those that do not are merged, and judged by their common counts. Purity is smoothed by the
purity of the node above, that of a host by the overall share; a template is rejected if it is low.
Only built-in functions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: A node's children are variable if at least so many of them have fewer urls each than this.
CHILDREN, EACH = 12, 4
#: Weight of the node above in a template's purity; the least purity; the deviate of the test.
PRIOR, PURITY, DEVIATE = 10.0, 0.5, 1.96
#: Fixed rules: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, host and path; both empty for a null url or one without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.select(*keep, F.translate(part(1), upper, upper.lower()).alias("host"), part(2).alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def segments_of(path: Column) -> Column:
    """Segments of a path; empty ones do not count."""
    return F.array_remove(F.split(path, "/"), "")


def smoothed(n: Column, bad: Column, above: Column) -> Column:
    """Share of good labels, drawn towards the purity above."""
    return (n - bad + PRIOR * above) / (n + PRIOR)


def differs(m: Column, b: Column, n: Column, bad: Column) -> Column:
    """Whether ``b`` poor of ``m`` labels differ from the rest of ``bad`` poor of ``n``; not without labels on both sides."""
    rest, share = n - m, bad / F.greatest(n, F.lit(1))
    gap = F.abs(b / F.greatest(m, F.lit(1)) - (bad - b) / F.greatest(rest, F.lit(1)))
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-3)) * (1 / F.greatest(m, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    return (m > 0) & (rest > 0) & (gap > DEVIATE * error)


def children(rows: DataFrame) -> DataFrame:
    """Rows (host, node, seg, piece, purity, mixed, shared) from open rows: each child's place in the next level.

    ``piece`` is the segment or the wildcard that stands for it, ``shared`` the segments that all
    paths below it have in common.
    """
    node = ["host", "node"]
    tail = F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1)))
    kids = rows.groupBy(*node, "seg").agg(*[F.sum(c).alias(c) for c in ("urls", "labelled", "poor")], F.min(tail).alias("low"),
                                          F.max(tail).alias("high"), F.first("purity").alias("above"))
    kids = stored(kids, "children")
    rare = (F.col("seg") != "") & (F.col("urls") < EACH)
    wild = kids.where(rare).groupBy(*node).agg(F.count("*").alias("many")).where(F.col("many") >= CHILDREN)
    kids = kids.join(wild, node, "left").withColumn(
        "piece", F.when(rare & F.col("many").isNotNull(), "*").otherwise(F.replace("seg", F.lit("*"), F.lit("%2A"))))
    pieces = kids.groupBy(*node, "piece").agg(F.sum("labelled").alias("m"), F.sum("poor").alias("b"), F.min("low").alias("low"),
                                              F.max("high").alias("high"), F.first("above").alias("above"))
    whole = kids.groupBy(*node).agg(F.sum("labelled").alias("n"), F.sum("poor").alias("bad"))
    pieces = pieces.join(whole, node).withColumn("differs", differs(F.col("m"), F.col("b"), F.col("n"), F.col("bad")))
    alike = pieces.groupBy(*node).agg(*[F.coalesce(F.sum(F.when(~F.col("differs"), F.col(c))), F.lit(0)).alias(c + "_alike") for c in "mb"],
                                      F.max("differs").alias("some"))
    purity = (F.when(F.col("differs"), smoothed(F.col("m"), F.col("b"), F.col("above")))
              .when(F.col("some"), smoothed(F.col("m_alike"), F.col("b_alike"), F.col("above"))).otherwise(F.col("above")))
    equal = F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False)))
    apart = F.array_position(equal, F.lit(False))
    shared = F.when(apart > 0, F.slice("low", F.lit(1), (apart - 1).cast("int"))).otherwise(F.col("low"))
    pieces = pieces.join(alike, node).select(*node, "piece", purity.alias("purity"), shared.alias("shared"),
                                             ((F.col("b") > 0) & (F.col("b") < F.col("m"))).alias("mixed"))
    return kids.select(*node, "seg", "piece").join(pieces, [*node, "piece"])


def templates(counted: DataFrame, good: float) -> DataFrame:
    """Rows (host, segments, template, purity) from counted paths (host, segments, urls, labelled, poor).

    ``**`` stands for what lies below a node whose labels are not mixed.
    """
    hosts = counted.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("poor").alias("bad"))
    hosts = hosts.select("host", smoothed(F.col("n"), F.col("bad"), F.lit(good)).alias("purity"),
                         ((F.col("bad") > 0) & (F.col("bad") < F.col("n"))).alias("mixed"))
    rows = counted.join(hosts, "host").select("*", F.lit("").alias("node"), F.col("segments").alias("rest"))
    done = []
    while True:
        rows = stored(rows, "tree")
        ended = ~F.col("mixed")
        below = F.when(F.size("rest") > 0, "/**").otherwise("")
        done.append(rows.where(ended).select("host", "segments", F.concat("node", below).alias("template"), "purity"))
        rows = rows.where(~ended).drop("mixed").withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        if rows.isEmpty():
            return reduce(DataFrame.union, done)
        at_end = F.col("seg") == ""
        step = F.concat(F.lit("/"), F.array_join(F.concat(F.array("piece"), F.transform("shared", lambda s: F.replace(s, F.lit("*"), F.lit("%2A")))), "/"))
        size = F.size("rest")
        rows = (rows.drop("purity").join(children(rows), ["host", "node", "seg"])
                .select("host", "segments", "urls", "labelled", "poor", "purity", (F.col("mixed") & ~at_end).alias("mixed"),
                        F.when(at_end, F.col("node")).otherwise(F.concat("node", step)).alias("node"),
                        F.slice("rest", F.size("shared") + 2, F.greatest(size, F.lit(1))).alias("rest")))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template and purity.

    ``labels`` has (number, poor): the first number in a path names its label; of several labels
    the worst counts. Without any label every url that no rule blocks is allowed.
    """
    number = F.expr("try_cast(regexp_extract(path, '[0-9]{1,18}', 0) as bigint)")
    urls = parsed(pages, "page_id").select("*", segments_of(F.col("path")).alias("segments"), number.alias("number"))
    worst = labels.where("number is not null and poor is not null").groupBy("number").agg(F.max("poor").alias("poor"))
    counted = (urls.select("host", "segments", "number").join(worst, "number", "left").groupBy("host", "segments")
               .agg(F.count("*").alias("urls"), F.count("poor").alias("labelled"), F.coalesce(F.sum("poor"), F.lit(0)).alias("poor")))
    counted = stored(counted, "paths")
    n, bad = counted.agg(F.sum("labelled"), F.sum("poor")).first()
    good = 1 - bad / n if n else 1.0
    known = templates(counted, good)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (urls.join(known, ["host", "segments"], "left")
            .select("page_id", "host", "path", text.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"),
                    "template", F.round("purity", 6).alias("purity")))
