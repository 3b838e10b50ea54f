"""Joining rows back to per-key statistics when a few keys are very hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot when it holds at least 1/HOT_SHARE of the rows, so there are at
# most HOT_SHARE hot keys and their list may always be broadcast.
HOT_SHARE = 1000
SALTS = 64
#: Rows of a bitmap that marks keys; 4 KB each.
MARK_BUCKETS = 512


def join_hot(rows: DataFrame, stats: DataFrame, keys: list[str], weight: str,
             row_id: list[str], how: str = "inner", weights: DataFrame | None = None,
             total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``stats``, which has one row per key.

    ``weight`` counts the rows of a key; it is a column of ``weights`` if given,
    else of ``stats``. Rows of hot keys are spread over SALTS sub-keys and the one
    matching stats row is repeated for each, so no task gets a whole hot key. The
    sub-key is a hash of ``row_id`` and not random: a recomputed task sends every
    row to the same place again. ``total`` is the number of rows, if known.
    """
    sizes = (stats if weights is None else weights).select(*keys, weight)
    if total is None:
        total = sizes.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).scalar()
    hot = F.broadcast(sizes.filter(F.col(weight) * HOT_SHARE >= total)
                      .select(*keys, F.lit(True).alias("_hot")))
    salted = (rows.join(hot, keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*row_id), F.lit(SALTS)))
                          .otherwise(F.lit(0)).cast("int"))
              .drop("_hot"))
    spread = (stats.join(hot, keys, "left")
              .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                             .otherwise(F.array(F.lit(0)))))
              .drop("_hot"))
    return salted.join(spread, keys + ["_salt"], how).drop("_salt")


def latest(df: DataFrame, keys: list[str], order: list[str], oldest: bool = False) -> DataFrame:
    """One row per key: the one with the greatest (or least) ``order`` values.

    An aggregate rather than a ranked window, so it combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if oldest else F.max_by
    best = pick(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_wide(df: DataFrame, keys: list[str], order: list[str], oldest: bool = False) -> DataFrame:
    """As ``latest``, for rows with long values: only keys that occur more than once are shuffled with them."""
    several = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    rows = with_mark(df, several, keys)
    return (rows.filter("not _marked").drop("_marked")
            .unionByName(latest(rows.filter("_marked").drop("_marked"), keys, order, oldest)))


def marks_of(listed: DataFrame, keys: list[str], buckets: int = MARK_BUCKETS) -> DataFrame:
    """Bitmap rows over hashes of the keys: ``buckets`` rows of 4 KB at most, whatever the number of keys."""
    n = _mark(keys, buckets)
    return (listed.select(F.bitmap_bucket_number(n).alias("_bucket"), F.bitmap_bit_position(n).alias("_p"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_p").alias("_bits")))


def _mark(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets * 32768)) + 1


def with_mark(rows: DataFrame, listed: DataFrame, keys: list[str], buckets: int = MARK_BUCKETS) -> DataFrame:
    """Add ``_marked``: true for rows whose keys are listed, and for few others that share a mark.

    A bitmap of the listed keys goes to the rows, so nothing of them is shuffled.
    """
    place = F.bitmap_bit_position(_mark(keys, buckets))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")) % 2 == 1
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(_mark(keys, buckets)))
            .join(F.broadcast(marks_of(listed, keys, buckets)), "_bucket", "left")
            .withColumn("_marked", F.coalesce(marked, F.lit(False))).drop("_bucket", "_bits"))
