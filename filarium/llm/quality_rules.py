"""Quality rules: a decision list learned from labelled documents, applied as Spark conditionals.

Statistics of the whole text are Column expressions. Sequential covering works on a table of
labelled statistics: each step is one aggregate over the rows that the rule so far covers,
which returns counts per statistic and threshold. A rule is grown on two thirds of the
labelled rows (information gain), pruned on the other third, and kept if it is precise there;
then its rows leave and the next rule is grown. The list comes out as ordered ``when``
conditions. Every labelled row takes part; the driver sees counts only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test, as expressions over the columns of ``statistics``.
STATISTICS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
NAMES = list(STATISTICS)
#: Shares at which thresholds are taken, of each class of labelled rows.
SHARES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]


def statistics(docs: DataFrame, keep: list[str | Column]) -> DataFrame:
    """Columns ``keep`` of documents (id, text), their counts and ``base_failed``.

    Null text counts as no words. Lines end at ``\\n``. A word is repeated if it lies in a
    window of eight words found twice or more in the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    many = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")
    d = docs.select(*keep, text.alias("text"), words_of(F.col("text")).alias("words"),
                    F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(*[F.col(c) for c in d.columns], F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    d = d.select(
        *[c for c in d.columns if c not in ("text", "words", "lines", "hashes")],
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - many(r"\x20\x09-\x0D")).alias("word_chars"),
        many(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        many("A-Z").alias("n_upper"),
        many("0-9").alias("n_digits"),
        many("!?.,;:").alias("n_marks"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"),
        F.size(F.filter("hashes", lambda h, i: h == F.get("hashes", i - 1))).cast("long").alias("n_echoes"),
        F.when(F.size("words") >= WINDOW, F.col("hashes")).alias("windows"))
    rest = [c for c in d.columns if c != "windows"]
    for step in (1, 2, 4):  # windows of two, four and eight words; the last seven places hold shorter ones
        d = d.select(*rest, F.transform("windows", lambda h, i: F.xxhash64(h, F.get("windows", i + step))).alias("windows"))
    d = d.select(*rest, F.slice("windows", 1, F.size("windows") - (WINDOW - 1)).alias("windows"))
    d = d.select(*rest, "windows", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("twice"))
    d = d.select(*rest, F.when(F.col("twice"), F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("pairs"))
    places = F.sort_array(F.transform(
        F.filter("pairs", lambda p, j: (p["h"] == F.get("pairs", j - 1)["h"]) | (p["h"] == F.get("pairs", j + 1)["h"])),
        lambda p: p["i"]))
    d = d.select(*rest, places.alias("places"))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda acc: acc["n"])
    # exploded, the count is not put in place of its name in filters above, where its parts would repeat
    d = d.select(*rest, F.explode(F.array(F.coalesce(covered, F.lit(0)).cast("long"))).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


@dataclass
class Rule:
    """Conjunction of (statistic, above, threshold); documents that meet it are rejected."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, limit in self.tests:
            out = out & ((F.col(name) > limit) if above else (F.col(name) <= limit))
        return F.coalesce(out, F.lit(False))

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if up else '<='} {t:.4g}" for n, up, t in self.tests)


def learn(labelled: DataFrame, label: str = "low", max_rules: int = 8, max_tests: int = 3,
          precision: float = 0.9, support: int = 5) -> list[Rule]:
    """Rules for rows whose ``label`` is 1, from rows of ``statistics`` with doc_id.

    Rows with a null label and rows that the base rules reject take no part. No rule comes out
    of a table without both classes, or where none covers ``support`` rows at ``precision``.
    """
    rows = labelled.where(F.col(label).isNotNull() & ~F.col("base_failed"))
    rows = stored(rows.select(F.col(label).cast("int").alias("y"),
                              (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"),
                              *[F.round(F.expr(STATISTICS[n]), 9).alias(n) for n in NAMES]), "labelled")
    cuts = {n: set() for n in NAMES}
    for r in rows.groupBy("y").agg(*[F.percentile_approx(n, SHARES, 2000).alias(n) for n in NAMES]).collect():
        for n in NAMES:
            cuts[n].update(x for x in r[n] or [] if x is not None)
    # thresholds lie halfway between neighbouring values of the two classes
    cuts = {n: [(a + b) / 2 for a, b in zip(sorted(v), sorted(v)[1:])] for n, v in cuts.items()}
    cuts = {n: v for n, v in cuts.items() if v}
    if not cuts:
        return []
    # the place of each value among the cuts: values up to cuts[k] have a place of at most k
    def place(n: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts[n]]), lambda t: t < F.col(n)))

    binned = stored(rows.select("y", "prune", F.array(*[place(n) for n in cuts]).alias("bins")), "labelled")
    order = list(cuts)

    def holds(tests) -> Column:
        out = F.lit(True)
        for f, above, k in tests:
            bin_ = F.get("bins", F.lit(f))
            out = out & ((bin_ > k) if above else (bin_ <= k))
        return out

    left, rules = F.lit(True), []
    while len(rules) < max_rules:
        tests: list[tuple[int, bool, int]] = []
        while len(tests) < max_tests:
            best = _best_test(binned.where(left & ~F.col("prune") & holds(tests)), [len(cuts[n]) for n in order], support)
            if best is None:
                break
            tests.append(best[0])
            if best[1] == 0:
                break
        if not tests:
            break
        kept = _pruned(binned.where(left & F.col("prune")), tests, holds, precision)
        if not kept:
            break
        rules.append(Rule([(order[f], above, cuts[order[f]][k]) for f, above, k in kept]))
        left = left & ~holds(kept)
    return rules


def _best_test(rows: DataFrame, sizes: list[int], support: int):
    """The test with the largest information gain and the other rows it would still cover."""
    counts: dict[tuple[int, int], tuple[int, int]] = {}
    for r in (rows.select("y", F.posexplode("bins").alias("f", "k")).groupBy("f", "k")
              .agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()):
        counts[r["f"], r["k"]] = (r["pos"], r["n"] - r["pos"])
    total = [sum(v[i] for (f, _), v in counts.items() if f == 0) for i in (0, 1)]
    if total[0] < support or not total[1]:
        return None
    base, best = log2(total[0] / sum(total)), None
    for f, size in enumerate(sizes):
        pos = neg = 0
        for k in range(size):
            pos, neg = pos + counts.get((f, k), (0, 0))[0], neg + counts.get((f, k), (0, 0))[1]
            for above, p, n in ((False, pos, neg), (True, total[0] - pos, total[1] - neg)):
                if p >= support and (gain := p * (log2(p / (p + n)) - base)) > 1e-9 and (best is None or gain > best[2] + 1e-9):
                    best = ((f, above, k), n, gain)
    return best and best[:2]


def _pruned(rows: DataFrame, tests, holds, precision: float):
    """The prefix of the tests that does best on the pruning rows; none if it is not precise there."""
    cols = []
    for i in range(1, len(tests) + 1):
        hit = holds(tests[:i])
        cols += [F.sum(F.when(hit, F.col("y"))).alias(f"p{i}"), F.count(F.when(hit, 1)).alias(f"n{i}")]
    r = rows.agg(*cols).first()
    best = None
    for i in range(1, len(tests) + 1):
        p, n = r[f"p{i}"] or 0, r[f"n{i}"]
        # ties go to the shorter rule
        if n and p / n >= precision and (best is None or (2 * p - n) / n > best[0] + 1e-9):
            best = ((2 * p - n) / n, tests[:i])
    return best and best[1]


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents with ``low``: 1 if a document's labels say poor.

    Several labels of a document: the worst counts. Labels without document or id are left out.
    """
    worst = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.max((F.col("quality") <= 0).cast("int")).alias("low")))
    return stats.join(worst, "doc_id")


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (the first rule met, else null) and ``kept`` to statistics."""
    names = stats.columns
    wide = stats.select(*names, *[F.round(F.expr(STATISTICS[n]), 9).alias(n) for n in {t[0] for r in rules for t in r.tests}])
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(r.column(), F.lit(str(r))).otherwise(verdict)
    out = wide.select(*names, F.when(~F.col("base_failed"), verdict).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: id, counts, base_failed, rule and kept. Nothing of an empty table."""
    stats = stored(statistics(docs, ["doc_id"]), "statistics")
    return judge(stats, learn(labelled_statistics(stats, labels), **options))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents that base rules and decision list keep, with all their columns.

    Texts are not shuffled: the list is learned from narrow statistics and the rules are
    evaluated again where the documents are read.
    """
    stats = stored(statistics(docs.select("doc_id", "text"), ["doc_id"]), "statistics")
    rules = learn(labelled_statistics(stats, labels), **options)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    judged = judge(statistics(wide, ["row"]), rules)
    # exploded, the verdict is not merged into a filter on the text, which would repeat its parts
    return judged.select("row", F.explode(F.array("kept")).alias("stays")).where("stays").select("row.*")
