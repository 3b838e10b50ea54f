"""Approximate nearest neighbours by learned partitions.

The index is fitted on at most ``SAMPLE`` distinct vectors, chosen by hash: their neighbour graph is
cut into parts of nearly equal size, and two small linear classifiers learn, one the part of a
vector, the other in which parts a query's neighbours lie. Every vector is then put into a part,
each query goes to its most probable parts, and the products with all vectors there are taken in
double precision. The number of parts that queries visit is the least that reaches ``RECALL``
on sample queries that the classifiers did not see.

Equal vectors count once: of a group only the smallest ids can be among the nearest, so a group
holds that many rows, and equal queries are searched once. A task takes a block of queries and a
slice of all vectors, part by part, and keeps the best so far, so only those leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

SAMPLE = 8192
PARTS = 16
#: Queries of a block; vectors of a slice, about, and the least number of slices.
BLOCK, SLICE, SLICES = 2048, 16_384, 4
RECALL = 0.97
GRAPH = 12


def clean(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) with an id and a vector that is neither null, empty nor zero and all finite."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _linear(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.05) -> np.ndarray:
    """Weights of a softmax classifier for the target shares ``y``, by Adam."""
    w = np.zeros((x.shape[1], y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (_soft(x @ w) - y) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


class Partitions:
    """Classifiers for the parts of vectors and queries, and the number of parts to visit."""

    def __init__(self, sample: np.ndarray, parts: int, k: int, recall: float = RECALL):
        norm = np.linalg.norm(sample, axis=1)
        self.scale = float(norm.mean())
        self.parts = parts = max(1, min(parts, len(sample) // 8))
        near = self._neighbours(sample, min(max(GRAPH, k), len(sample) - 1))
        label = self._cut(sample, near[:, :GRAPH])
        hard = np.eye(parts)[label]
        test = np.arange(len(sample)) % 5 == 0
        soft = hard[near].mean(axis=1) if near.shape[1] else hard
        x = self._features(sample)
        self.own = _linear(x, hard)
        placed = (x @ self.own).argmax(axis=1)
        query = _linear(x[~test], soft[~test])
        order = np.argsort(-(x[test] @ query), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(parts)[None], axis=1)
        got = np.take_along_axis(place, placed[near[test]], axis=1) if near.shape[1] else np.zeros((1, 1))
        share = np.array([(got < p).mean() for p in range(1, parts + 1)])
        self.visits = int(np.argmax(share >= recall)) + 1 if (share >= recall).any() else parts
        self.query = _linear(x, soft)

    @staticmethod
    def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((len(x), max(k, 0)), np.int64)
        for at in range(0, len(x) if k > 0 else 0, 1024):
            s = x[at:at + 1024] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out[at:at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
        return out

    def _cut(self, x: np.ndarray, near: np.ndarray, sweeps: int = 12) -> np.ndarray:
        """Parts of nearly equal size with few graph edges between them: balanced growth, then moves that gain edges."""
        n, parts, rng = len(x), self.parts, np.random.default_rng(5)
        room = -(-n * 11 // (10 * parts))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = unit[rng.choice(n, parts, replace=False)]
        label = np.zeros(n, np.int64)
        for _ in range(6):
            s = unit @ centre.T
            wish = np.argsort(-s, axis=1)
            load, label = np.zeros(parts, np.int64), np.full(n, -1)
            for i in np.argsort(-s.max(axis=1), kind="stable").tolist():
                label[i] = p = next(p for p in wish[i].tolist() if load[p] < room)
                load[p] += 1
            centre = np.stack([unit[label == p].sum(axis=0) for p in range(parts)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        src = np.repeat(np.arange(n), near.shape[1])
        ends = np.concatenate([np.stack([src, near.ravel()], 1), np.stack([near.ravel(), src], 1)])
        ends = ends[np.argsort(ends[:, 0], kind="stable")]
        first = np.searchsorted(ends[:, 0], np.arange(n + 1))
        load = np.bincount(label, minlength=parts)
        for _ in range(sweeps if near.shape[1] else 0):
            moved = 0
            for i in rng.permutation(n).tolist():
                votes = np.bincount(label[ends[first[i]:first[i + 1], 1]], minlength=parts).astype(float)
                votes[load >= room] = -1
                votes[label[i]] = max(votes[label[i]], np.count_nonzero(label[ends[first[i]:first[i + 1], 1]] == label[i]))
                to = int(votes.argmax())
                if votes[to] > votes[label[i]]:
                    load[label[i]] -= 1
                    load[to] += 1
                    label[i] = to
                    moved += 1
            if moved < n // 500:
                break
        return label

    @classmethod
    def of(cls, state: dict) -> Partitions:
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def _features(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.concatenate([x / np.maximum(norm, 1e-300) * np.sqrt(x.shape[1]), norm / self.scale, np.ones((len(x), 1))], axis=1)

    def part(self, x: np.ndarray) -> np.ndarray:
        return (self._features(x) @ self.own).argmax(axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(self._features(x) @ self.query), axis=1, kind="stable")[:, :self.visits]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product, itself left out.

    ``vectors`` and ``queries`` have (vec_id, embedding). Rows without id or with an unfit vector
    take no part. Vectors that differ in length meet over the components that both have. Rows of one
    id and vector count once; ties go to the smaller id. With few vectors all candidates come back.
    """
    base, asked = stored(clean(vectors), "vectors"), clean(queries)
    width = F.size("v").alias("n")
    least, most = base.select(width).union(asked.select(width)).agg(F.min("n"), F.max("n")).first()
    if least != most:  # zeros at the end change no product
        base, asked = (t.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v")))) for t in (base, asked))
    base, asked = (t.withColumn("h", F.xxhash64("v")) for t in (base, asked))
    alike = Window.partitionBy("h", "v").orderBy("vec_id")
    first = (base.distinct().withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1).drop("r"))
    once = asked.groupBy("h", "v").agg(F.min("vec_id").alias("vec_id"))
    first = stored(first, "vectors")
    total = first.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one = Window.partitionBy("h", "v").orderBy("vec_id")
    sample = (first.withColumn("r", F.row_number().over(one)).where("r = 1").orderBy("h", "vec_id").limit(SAMPLE)
              .select("v").toArrow())
    model = Partitions(_matrix(sample.column(0).combine_chunks(), sample.num_rows), PARTS, k)
    shared = vectors.sparkSession.sparkContext.broadcast(vars(model))  # two matrices of PARTS columns

    def place(batches):
        for t in batches:
            if t.num_rows:
                part = Partitions.of(shared.value).part(_matrix(t.column(2), t.num_rows))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(part.astype(np.int32))], names=["h", "vec_id", "v", "part"])

    def route(batches):
        for t in batches:
            if t.num_rows:
                routes = Partitions.of(shared.value).routes(_matrix(t.column(2), t.num_rows)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(list(routes), pa.list_(pa.int32()))], names=["h", "vec_id", "v", "parts"])

    placed = first.select("h", "vec_id", "v").mapInArrow(place, "h long, vec_id long, v array<double>, part int")
    routed = stored(once.select("h", "vec_id", "v").mapInArrow(route, "h long, vec_id long, v array<double>, parts array<int>"), "routed")
    blocks = max(1, -(-routed.count() // BLOCK))
    slices = max(SLICES, -(-total // SLICE))
    turn = lambda n: F.pmod(F.xxhash64("vec_id", "h"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.array().cast("array<int>")
    rows = (routed.select(every(slices).alias("slice"), turn(blocks).alias("block"), F.lit(-1).alias("part"), "h", "vec_id", "v", "parts")
            .union(placed.select(turn(slices).alias("slice"), every(blocks).alias("block"), "part", "h", "vec_id", "v", nothing)))
    rows = rows.repartition("slice", "block").sortWithinPartitions("slice", "block", "part", "vec_id")

    def meet(batches):
        now, best = None, None
        for t in batches:
            keys = np.stack([t.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), t.num_rows] if t.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                if tuple(keys[a][:2]) != now:
                    if best:
                        yield from best.rows()
                    now, best = tuple(keys[a][:2]), _Best(k + 1)
                best.add(int(keys[a][2]), t.slice(a, b - a))
        if best:
            yield from best.rows()

    found = rows.mapInArrow(meet, "h long, query_first long, vec_id long, score double")
    best = Window.partitionBy("h", "query_first").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    names = asked.select(F.col("vec_id").alias("query_id"), "h", "v").distinct().join(
        once.select("h", "v", F.col("vec_id").alias("query_first")), ["h", "v"]).drop("v")
    own = Window.partitionBy("query_id", "h", "query_first").orderBy(F.col("score").desc(), "vec_id")
    return (names.join(found, ["h", "query_first"]).where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


class _Best:
    """The nearest vectors so far of a block of queries, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.asked, self.ready = k, [], False
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, part: int, t: pa.RecordBatch) -> None:
        if part < 0:
            self.asked.append(t)
            return
        if not self.asked:
            return
        if not self.ready:
            t0 = pa.Table.from_batches(self.asked).combine_chunks().to_batches()[0]
            self.h, self.query, self.q = t0.column(3).to_numpy(), t0.column(4).to_numpy(), _matrix(t0.column(5), t0.num_rows)
            self.parts = _matrix(t0.column(6), t0.num_rows)
            self.floor, self.ready = np.full(t0.num_rows, -np.inf), True
        ask = np.flatnonzero((self.parts == part).any(axis=1))
        ids, x = t.column(4).to_numpy(), _matrix(t.column(5), t.num_rows)
        for at in range(0, len(x) if len(ask) else 0, 1024):
            y = x[at:at + 1024]
            s = self.q[ask] @ y.T
            own = np.partition(s, len(y) - self.k, axis=1)[:, len(y) - self.k] if len(y) > self.k else np.full(len(s), -np.inf)
            # products in one fixed order for all that rounding could bring to the top
            least = np.maximum(own, self.floor[ask]) - 1e-9 * (1 + np.abs(s).max(axis=1))
            r, c = np.nonzero(s >= least[:, None])
            exact = [(self.q[ask[r[i:i + 65536]]] * y[c[i:i + 65536]]).sum(axis=1) for i in range(0, len(r), 65536)]
            self._merge(ask[r], ids[at + c], np.concatenate([np.zeros(0), *exact]))

    def _merge(self, row, ids, score) -> None:
        row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[row[last]] = score[last]
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]

    def rows(self):
        for at in range(0, len(self.row), 10_000):
            r = self.row[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.h[r]), pa.array(self.query[r]), pa.array(self.id[at:at + 10_000]),
                                              pa.array(self.score[at:at + 10_000])], names=["h", "query_first", "vec_id", "score"])
