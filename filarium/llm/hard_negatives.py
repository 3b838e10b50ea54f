"""Hard negatives of anchors by a secondary-sort shuffle.

A row's score is its integer inner product with the anchor. An anchor's positives are the best
rows of its label; a positive opens a window of scores below its own, and the best rows of other
labels in the window are its negatives. Blocks of anchors meet slices of rows in tasks; a task
returns, for each window of an anchor, the best rows of its slice only. These pairs are shuffled
by anchor and sorted by (anchor, descending score, id); a pass over the sorted stream opens the
windows of positives as they come and emits the negatives, holding a few open windows and never
an anchor's rows.

A first pass over one row in ``FIRST`` bounds what the full pass must return, without loss: the k-th
best of some rows is no better than the k-th best of all.

Rows take no part without an id, a label or a vector, or with a null or non-finite component. Rows
of one id count once, with the least label and vector. Components count as integers floor(256 x)
between -2^24 and 2^24. Vectors of different length don't meet. Other columns are ignored.
An anchor without positives, or whose positives have no fitting row, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Anchors of a block and rows of a slice, about.
BLOCK = SLICE = 16_384
#: Rows scored at once.
TILE = 512
#: One row in so many is in the first pass.
FIRST = 64
LIMIT = 1 << 24
LEAST, MOST = -(1 << 62), 1 << 62


def clean(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v) that take part, v as integers."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ok)
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("v")).alias("s"))
            .groupBy("vec_id").agg(F.min("s").alias("s")).select("vec_id", "s.label", "s.v"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if len(column.flatten()) else np.zeros((rows, 0), np.int64)


class _Block:
    """A block of anchors with their windows, and the best rows so far in each window."""

    def __init__(self, t: pa.Table, same: bool, k: int):
        t = t.combine_chunks()
        self.same, self.k = same, k
        self.id, self.label = t["vec_id"].to_numpy(), t["label"].to_numpy()
        self.q = _matrix(t["v"].combine_chunks(), len(t))
        self.low, self.high = _matrix(t["low"].combine_chunks(), len(t)), _matrix(t["high"].combine_chunks(), len(t))
        self.floor = self.low - 1
        self.cold = True
        wide = int(np.abs(self.q).max(initial=0)) * LIMIT * max(1, self.q.shape[1])
        self.kind = np.float64 if wide < 1 << 53 else np.int64
        self.q = self.q.astype(self.kind)
        self.kept = [np.zeros((0, 3), np.int64)] * self.low.shape[1]  # anchor's place, score, id

    def meet(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        """Takes rows in the order of their ids."""
        score = (self.q @ x.T.astype(self.kind)).astype(np.int64)
        fits = (self.label[:, None] == label) if self.same else (self.label[:, None] != label)
        if self.same:
            fits &= self.id[:, None] != ids
        for w in range(self.low.shape[1]):
            inside = fits & (score > self.floor[:, w, None]) & (score <= self.high[:, w, None])
            if self.cold and len(ids) > self.k:
                shown = np.where(inside, score, LEAST)
                inside &= score >= np.partition(shown, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
            r, c = np.nonzero(inside)
            if len(r):
                self._keep(w, np.stack([r, score[r, c], ids[c]], 1))
        self.cold = False

    def _keep(self, w: int, new: np.ndarray) -> None:
        rows = np.concatenate([self.kept[w], new])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        rank = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        last = rows[rank == self.k - 1]
        self.floor[last[:, 0], w] = last[:, 1]  # full: a later id must be better
        self.kept[w] = rows[rank < self.k]

    def rows(self):
        for w, kept in enumerate(self.kept):
            for at in range(0, len(kept), 10_000):
                part = kept[at:at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(self.id[part[:, 0]]), pa.array(np.full(len(part), w, np.int32)), pa.array(part[:, 1]), pa.array(part[:, 2])],
                    names=["anchor_id", "window", "score", "vec_id"])


def best_in_windows(rows: DataFrame, anchors: DataFrame, k: int, same: bool, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """Rows (anchor_id, window, score, vec_id): of each slice the ``k`` best in each window of an anchor.

    ``rows`` has (vec_id, label, v), ``anchors`` also arrays low and high of window bounds, all of one
    length. ``same`` takes rows of the anchor's label, itself left out, else rows of other labels.
    """
    blocks, slices = max(1, -(-anchors.count() // block)), max(1, -(-rows.count() // slice_))
    turn = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.lit(None).cast("array<long>")
    dealt = (anchors.select(F.size("v").alias("width"), turn(blocks).alias("block"), every(slices).alias("slice"), F.lit(0).alias("role"),
                            "vec_id", "label", "v", "low", "high")
             .union(rows.select(F.size("v"), every(blocks), turn(slices), F.lit(1), "vec_id", "label", "v", nothing, nothing)))
    # one number for the three, so that cells land as evenly as hashes do
    dealt = dealt.withColumn("cell", F.xxhash64("width", "block", "slice")).repartition("cell")
    dealt = dealt.sortWithinPartitions("width", "block", "slice", "role", "vec_id")

    def run(batches):
        now, asked, open_ = None, [], None
        for t in batches:
            keys = np.stack([t.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                cell, part = tuple(keys[a][:3].tolist()), t.slice(a, b - a)
                if cell != now:
                    if open_:
                        yield from open_.rows()
                    now, asked, open_ = cell, [], None
                if keys[a][3] == 0:
                    asked.append(part)
                    continue
                if not asked and not open_:
                    continue
                if not open_:
                    open_, asked = _Block(pa.Table.from_batches(asked), same, k), []
                ids, label, x = part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6), part.num_rows)
                for at in range(0, len(ids), TILE):
                    open_.meet(ids[at:at + TILE], label[at:at + TILE], x[at:at + TILE])
        if open_:
            yield from open_.rows()

    return dealt.drop("cell").mapInArrow(run, "anchor_id long, window int, score long, vec_id long")


def _bounded(rows: DataFrame, anchors: DataFrame, k: int, same: bool, first: int) -> DataFrame:
    """As ``best_in_windows``, with windows narrowed before by what one row in ``first`` shows."""
    some = rows.where(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(first)) == 0)
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    seen = (best_in_windows(some, anchors, k, same).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            .where(F.col("r") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("seen")))
    low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("seen", i), x)))
    narrow = (anchors.join(seen, anchors["vec_id"] == seen["anchor_id"], "left").withColumn("low", F.coalesce(low, "low"))
              .select("vec_id", "label", "v", "low", "high"))
    return best_in_windows(rows, stored(narrow, "anchors"), k, same)


def mine(vectors: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, first: int = FIRST) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (vec_id, label, embedding), ``is_anchor`` is a condition on vec_id. Positives are the
    first ``n_positives`` other rows of the anchor's label by score, ties to the smaller id; negatives of
    each the first ``n_negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    rows = stored(clean(vectors), "vectors")
    asked = stored(rows.where(is_anchor), "anchors")
    one = lambda x: F.array(F.lit(x).cast("long"))
    near = _bounded(rows, asked.select("*", one(LEAST).alias("low"), one(MOST).alias("high")), n_positives, True, first)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    positives = stored(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_positives)
                       .select("anchor_id", "score", "vec_id"), "positives")
    # bounds in whole numbers; below zero no score fits, so such positives get an empty window
    pad = f"transform(sequence(1, {n_positives} - size(p)), x -> {{}}L)"
    bounds = lambda term, empty: F.expr(
        f"concat(transform(p, x -> if(x < 0, {empty}L, {term})), if(size(p) < {n_positives}, {pad.format(empty)}, array()))")
    windows = positives.groupBy("anchor_id").agg(F.collect_list("score").alias("p")).select(
        "anchor_id", bounds(f"(x * {low} + 99) div 100", MOST).alias("low"), bounds(f"(x * {high}) div 100", LEAST).alias("high"))
    far = _bounded(rows, asked.join(windows, asked["vec_id"] == windows["anchor_id"]).drop("anchor_id"), n_negatives, False, first)
    pairs = (positives.select("anchor_id", "score", F.lit(0).alias("role"), "vec_id")
             .union(far.select("anchor_id", "score", F.lit(1), "vec_id")))

    def emit(batches):
        now, before, open_ = None, None, []
        for t in batches:
            out = []
            for anchor, score, role, vec_id in zip(*(c.to_pylist() for c in t.columns)):
                if anchor != now:
                    now, before, open_ = anchor, None, []
                if role == 0:
                    open_.append([score, vec_id, 0])
                elif vec_id != before:  # a row may come from several windows
                    before = vec_id
                    for w in open_:
                        if w[2] < n_negatives and low * w[0] <= 100 * score <= high * w[0]:
                            w[2] += 1
                            out.append((anchor, w[1], w[2], vec_id, w[0], score))
            if out:
                cols = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for c, n in zip(cols, names)], names=names)

    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # of equal scores the positives come first, as a score of 0 lies in its own window
    return (pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.col("score").desc(), "role", "vec_id")
            .mapInArrow(emit, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
