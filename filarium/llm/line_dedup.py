"""Fuzzy line dedup: MinHash bands, exact Jaccard, connected components, one line kept per component.

A line's set holds the hashes of its character shingles: the ``WIDTH`` characters (lower-cased)
that start at each word, so its size follows the words and a changed letter touches two or
three shingles. A word longer than that also gives its last ``WIDTH`` characters and all runs of
``WIDTH`` characters within it. About one character in ``LIGHT`` starts a word, so such a run weighs one
``LIGHT``-th of a shingle at an end, and a long word about as much as short words of its length:
similarity is the weight that two sets share over the weight of all their hashes.

Each of ``BANDS`` bands takes the least of ``ROWS`` independent hashes of a set. Two sets with i of u
in common share a band with the probability (i / u) ** ``ROWS``, whatever the other bands do.
The README has the recall by line length.

Equal lines are one class from the start, so large groups of copies are one row. In each band
every class first meets the most frequent one; the pairs of a band still unconnected after that
are compared as well, so no pair that shares a band is left out. Before sets meet, two parity
words of theirs do: each hash of an end flips one of 256 bits, so at least as many hashes as differing
bits belong to one set alone, and a pair with too many cannot be similar. Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filarium.operators.skew import with_mark

from .common import SPACE_CLASS, components, stored

WIDTH = 12
BANDS, ROWS = 12, 3
#: Shingles inside a long word that weigh as much as one at the start of a word.
LIGHT = 6
#: Rows of 4 KB in the bitmap of lines that meet others, 67 million bits.
MARKS = 2048
SIMILAR = 0.8


def shingles(line: Column) -> Column:
    """Hashes of the character shingles of a line, some more than once; those of ``_inner`` are below zero."""
    return F.when(_long(line), F.concat(_ends(line), _inner(line))).otherwise(_ends(line))


def _ends(line: Column) -> Column:
    # a look ahead takes the shingle, then the word is passed over; a longer word only up to its last WIDTH characters
    own = F.regexp_extract_all(F.lower(line), F.lit(
        rf"(?s)(?=([^\x20\x09-\x0D].{{0,{WIDTH - 1}}}+))(?:[^\x20\x09-\x0D]{{1,{WIDTH}}}+(?:[\x20\x09-\x0D]++|\z)"
        rf"|[^\x20\x09-\x0D]+(?=[^\x20\x09-\x0D]{{{WIDTH}}}(?![^\x20\x09-\x0D])))"), F.lit(1))
    return F.transform(own, _hash)


def _inner(line: Column) -> Column:
    """Hashes of all runs of ``WIDTH`` characters within longer words."""
    long = F.regexp_extract_all(F.lower(line), F.lit(rf"[^\x20\x09-\x0D]{{{WIDTH + 1},}}+"), F.lit(0))
    all_ = F.flatten(F.transform(long, lambda w: F.regexp_extract_all(w, F.lit(rf"(?s)(?=(.{{{WIDTH}}}))."), F.lit(1))))
    return F.transform(all_, lambda s: -1 - _hash(s))


def _long(line: Column) -> Column:
    # most lines have no such word; the blank before lets the search start at blanks only
    return F.concat(F.lit(" "), F.lower(line)).rlike(rf"[\x20\x09-\x0D][^\x20\x09-\x0D]{{{WIDTH + 1}}}")


def _hash(s: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(s), 2)


def with_bands(rows: DataFrame, *keep: str, times: Column | None = None) -> DataFrame:
    """Columns ``keep``, once each, and ``bands``, the band keys of their column ``hashes``, in which repeats do no harm.

    ``times`` is how much less than one a hash ``h`` weighs, and so how much larger its numbers are.
    """
    # 28 bits of a hash: the least of many are small numbers, which the shuffle compresses
    number = lambda k: F.shiftrightunsigned(F.xxhash64("h", F.lit(k)), 36)
    least = [F.min(number(k) if times is None else number(k) * F.col("times")).alias(f"m{k}") for k in range(BANDS * ROWS)]
    # the outer form, as the inner one adds a filter that works out the sets a second time
    rows = rows.select(*keep, F.explode_outer("hashes").alias("h"))
    found = (rows if times is None else rows.withColumn("times", times)).groupBy(*keep).agg(*least)
    return found.select(*keep, F.array(*[F.xxhash64(F.lit(b), *[f"m{ROWS * b + r}" for r in range(ROWS)]) for b in range(BANDS)]).alias("bands"))


def split_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, line_no, line) of lines with a word; line numbers count from 0 at every ``\\n``."""
    # a null text gives a null line, which the filter drops
    return (docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
            .where(F.col("line").rlike("[^" + SPACE_CLASS[1:])))


def _id() -> Column:
    """A line's class: its 64-bit hash, the same for equal lines; others are not to be expected to share one."""
    return F.xxhash64("line")


def line_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per line with a word: doc_id, line_no, keeper_doc_id, keeper_line_no, kept.

    A line's keeper is the first line, by doc_id and number, of its component; null ids come
    first. Lines at one place, of rows that share a doc_id, tie: all of them are kept if one is a
    keeper. Null and empty texts have no lines.
    """
    return _judged(docs, similar).drop("text_key")


def _judged(docs: DataFrame, similar: float) -> DataFrame:
    """The rows of ``line_classes`` with a hash of their text, which tells rows of one doc_id apart."""
    lines = split_lines(docs.select("doc_id", "text"))
    place = F.struct("doc_id", "line_no")
    placed = stored(lines.select("doc_id", "text_key", "line_no", _id().alias("id")), "placed")
    classes = stored(placed.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "classes")
    banded = with_bands(lines.select(_id().alias("id"), shingles(F.col("line")).alias("hashes")), "id",
                        times=F.when(F.col("h") < 0, LIGHT).otherwise(1))
    links = stored(_links(lines, _met(banded, classes), similar), "links")
    parts = components(links, "a", "b")
    grouped = (classes.join(parts, "id", "left")
               .select("id", "first", F.coalesce("component", "id").alias("component")))
    # only components of several classes need a common keeper
    keepers = parts.join(classes, "id").groupBy("component").agg(F.min("first").alias("keeper"))
    keeper = (grouped.join(keepers, "component", "left")
              .select("id", F.coalesce("keeper", "first").alias("keeper")))
    return (placed.join(keeper, "id")
            .select("doc_id", "text_key", "line_no", F.col("keeper.doc_id").alias("keeper_doc_id"),
                    F.col("keeper.line_no").alias("keeper_line_no"),
                    place.eqNullSafe(F.col("keeper")).alias("kept")))


def _met(banded: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (band, id, copies) of the bands in which several classes meet."""
    held = banded.select(F.explode("bands").alias("band"), "id").repartition("band")  # one shuffle for both uses
    meets = held.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band")
    met = held.join(meets.hint("shuffle_hash"), "band")
    return stored(stored(met, "met").join(classes.select("id", "copies"), "id"), "met")


def _links(lines: DataFrame, met: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of similar classes that connect all similar classes sharing a band."""
    chosen = met.select("id").distinct()
    # a bitmap keeps the other lines out of the shuffle
    marked = with_mark(lines.select(_id().alias("id"), "line"), chosen, ["id"], MARKS).where("_marked").select("id", "line")
    found = marked.dropDuplicates(["id"]).join(chosen, "id", "left_semi")
    line = F.col("line")
    sets = found.select("id", F.array_distinct(_ends(line)).alias("hashes"), F.when(_long(line), F.array_distinct(_inner(line))).alias("inner"))
    n = LIGHT * F.size("hashes") + F.coalesce(F.size("inner"), F.lit(0))
    sets = stored(sets.select("id", "hashes", "inner", n.alias("n"), *[_parity(w).alias(f"p{w}") for w in range(4)]), "sets")
    parity = [f"p{w}" for w in range(4)]
    met = stored(met.select("band", "id", "copies").join(sets.select("id", "n", *parity), "id"), "met")

    hubs = met.groupBy("band").agg(F.max(F.struct("copies", "id", "n", *parity)).alias("hub"))
    near = (F.least("n", "m") >= similar * F.greatest("n", "m")) & (
        sum(F.bit_count(F.col(c).bitwiseXOR(F.col("q" + c[1:]))) for c in parity) * LIGHT * (1 + similar) <= (1 - similar) * (F.col("n") + F.col("m")) + 1e-6)
    other = lambda source: [F.col(f"{source}id").alias("other"), F.col(f"{source}n").alias("m"), *[F.col(source + c).alias("q" + c[1:]) for c in parity]]
    stars = met.join(hubs, "band").where("id <> hub.id").select("id", "n", *parity, *other("hub.")).where(near)
    first = stored(_verified(stars, sets, similar), "links")
    parts = components(first, "a", "b")

    placed = met.drop("copies").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    mixed = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band")
    open_ = stored(placed.join(mixed, "band").join(hubs.select("band", F.col("hub.id").alias("hub")), "band")
                   .where("id <> hub").drop("hub"), "open")
    pairs = open_.join(open_.select("band", F.col("part").alias("part2"), *other("")), "band").where(
        (F.col("id") < F.col("other")) & (F.col("part") != F.col("part2")) & near)
    return first.union(_verified(pairs.select("id", "other"), sets, similar))


def _parity(word: int) -> Column:
    """One of four 64-bit words in which each hash flips its bit."""
    own = F.filter("hashes", lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(3)) == word)
    return F.aggregate(own, F.lit(0).cast("long"), lambda w, h: w.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    once = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    side = lambda i, x: sets.select(F.col("id").alias(i), F.col("hashes").alias(x), F.col("inner").alias(x + "i"), F.col("n").alias(x + "n"))
    both = once.join(side("a", "x"), "a").join(side("b", "y"), "b")
    inner = F.when(F.col("xi").isNotNull() & F.col("yi").isNotNull(), F.size(F.array_intersect("xi", "yi"))).otherwise(0)
    both = both.select("a", "b", (LIGHT * F.size(F.array_intersect("x", "y")) + inner).alias("i"), (F.col("xn") + F.col("yn")).alias("s"))
    return both.where(F.col("i") >= similar * (F.col("s") - F.col("i"))).select("a", "b")


def drop_repeated_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Documents without the lines that repeat an earlier one, with all their columns.

    ``n_chars``, where it exists, is set anew. A document that loses every line goes; one
    without any line stays as it is. Rows that share a doc_id, or have none, lose only lines of their own.
    """
    gone = (_judged(docs, similar).where("not kept").groupBy("doc_id", "text_key")
            .agg(F.sort_array(F.collect_set("line_no")).alias("gone")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wide = docs.select(row).join(gone.select(F.col("doc_id").alias("id"), "text_key", "gone"),
                                 F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("text_key")), "left")
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    wide = wide.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text"))
    wide = wide.where(F.col("gone").isNull() | F.col("text").rlike("[^" + SPACE_CLASS[1:]))
    cols = [F.col("text") if c == "text" else
            F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars")
            if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return wide.select(*cols)
