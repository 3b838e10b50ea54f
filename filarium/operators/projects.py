"""Project grouping.

Candidate pairs come from shared blocks: a tag, an entity, a file-name token or a
folder prefix. A pair without any of these reaches .10 + .05 + .10 = .25 at most;
one that shares only folders needs a proximity of .4, so blocking loses no link.
Blocks are cut into tiles of bounded size. A tile scores its pairs as matrices and
returns one row per file (its local group) and one per local group (signal sums),
never the pairs themselves. The tiles of large blocks run in rounds, so that copies of
a row for one share of its tiles only lie on disk at a time; files that earlier rounds
have joined are one in later ones, which then return few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from filarium import constants as K
from filarium.functions import (capitalise, cosine01, date_proximity, dice, folder_proximity, jaccard,
                                name_tokens, plural, segments, sql_like, stem)
from filarium.operators.skew import join_hot
from filarium.session import cut_lineage, write_table

SIGNALS = list(K.SIGNAL_WEIGHTS)
TILE_ROWS = 8192
# Pairs of a tile are scored between pieces of so many rows.
CHUNK = 1024
# Small tiles are scored together until they hold this many rows.
SMALL_TILES = 128
# Rows of a round of tiles, as a multiple of the rows of all blocks.
ROUND_COPIES = 2


# ---- features and pair signals -----------------------------------------------------

def augment_findings(findings: DataFrame, tags: DataFrame, entities: DataFrame,
                     chunks: DataFrame) -> DataFrame:
    """Add tags, entities and the first-chunk vector of each finding.

    The sets stay small: tags come from one rule and entities from one text of
    limited length.
    """
    t = tags.groupBy("finding_id").agg(F.collect_set(F.lower("tag")).alias("tags"))
    e = entities.groupBy("finding_id").agg(F.collect_set(F.lower("value")).alias("entities"))
    v = chunks.filter("chunk_index = 0").select("finding_id", "vector")
    none = F.array().cast("array<string>")
    return (findings.join(t, "finding_id", "left").join(e, "finding_id", "left").join(v, "finding_id", "left")
            .withColumn("tags", F.coalesce("tags", none)).withColumn("entities", F.coalesce("entities", none)))


def pair_signals(a: str, b: str) -> Column:
    """Struct of the seven signals between two augmented structs."""
    def both(name):
        return F.col(f"{a}.{name}"), F.col(f"{b}.{name}")

    ca, cb = both("ai_category")
    na, nb = both("name")
    return F.struct(
        folder_proximity(*both("path")).alias("folder_proximity"),
        dice(*both("tags")).alias("shared_tags"),
        dice(*both("entities")).alias("shared_entities"),
        jaccard(name_tokens(na), name_tokens(nb)).alias("filename_similarity"),
        F.when((ca != "") & (ca == cb), 1.0).otherwise(0.0).alias("shared_ai_category"),
        date_proximity(*both("modified_at")).alias("date_proximity"),
        cosine01(*both("vector")).alias("semantic_similarity"))


def signal_score(signals: Column) -> Column:
    """Weighted score of a signal struct, at most 1."""
    total = F.lit(0.0)
    for name, weight in K.SIGNAL_WEIGHTS.items():
        total = total + signals[name] * weight
    return F.least(total, F.lit(1.0))


def score_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Score given pairs of augmented structs."""
    return (pairs.withColumn("signals", pair_signals(a, b))
            .withColumn("score", signal_score(F.col("signals"))))


# ---- links by tiles -------------------------------------------------------------------

def _features(aug: DataFrame, projects: DataFrame | None, rejected: DataFrame | None,
              per_scan: bool) -> DataFrame:
    """Compact numeric features and block keys of each finding."""
    scope = F.col("scan_id").cast("string") if per_scan else F.lit("")

    def hashed(arr):
        return F.transform(arr, lambda x: F.xxhash64(x))

    segs = segments(F.col("path"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("_segs")),
                         lambda d: F.xxhash64(F.array_join(F.slice("_segs", F.lit(1), d), "/")))
    df = (aug.withColumn("_segs", segs)
          .withColumn("prefixes", F.when(F.size("_segs") > 0, prefix).otherwise(F.array().cast("array<bigint>")))
          .withColumn("_tags", F.array_distinct("tags")).withColumn("_ents", F.array_distinct("entities"))
          .withColumn("_toks", name_tokens(F.col("name"))))
    none = F.array().cast("array<bigint>")
    for name, source in (("approved", projects), ("rejected", rejected)):
        if source is None:
            df = df.withColumn(name, none)
        else:
            own = source.groupBy("finding_id").agg(F.collect_set("group_id").alias(name))
            df = df.join(own, "finding_id", "left").withColumn(name, F.coalesce(name, none))

    def keys(kind, arr):
        return F.transform(arr, lambda x: F.struct(F.xxhash64(scope, F.lit(kind), x).alias("key"),
                                                   F.lit(True).alias("short")))

    n = F.size("_segs")
    depth = (lambda m: F.ceil(m * 0.4 - 1e-9).cast("int"))
    folder = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda m: F.struct(
        F.xxhash64(scope, F.lit("f"), m, F.get("prefixes", depth(m) - 1)).alias("key"), (m == n).alias("short"))))
    all_keys = F.flatten(F.filter(F.array(keys("t", F.col("_tags")), keys("e", F.col("_ents")),
                                          keys("n", F.col("_toks")), folder), lambda x: x.isNotNull()))
    return df.select(
        F.col("finding_id").alias("id"), "prefixes", hashed("_tags").alias("tags"), hashed("_ents").alias("ents"),
        hashed("_toks").alias("toks"), F.xxhash64(F.nullif("ai_category", F.lit(""))).alias("cat"),
        (F.coalesce("ai_category", F.lit("")) != "").alias("has_cat"),
        F.unix_millis("modified_at").alias("ms"), "vector", "approved", "rejected", all_keys.alias("_keys"))


def _blocked(feats: DataFrame, tile_rows: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(rows with the blocks they are in and the number of tiles a side of each, rounds of tiles).

    A block is kept if it has two members, one of which may be the shorter path.
    """
    keys = feats.select("id", F.explode("_keys").alias("k")).select("id", "k.key", "k.short")
    blocks = (keys.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("short").alias("s"))
              .filter("n > 1 and s").drop("s"))
    blocks = cut_lineage(blocks.withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int")))
    kept = (join_hot(keys.select("id", "key"), blocks, ["key"], "n", ["id"])
            .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "tiles"))).alias("_kept")))
    # one row for each number of tiles
    sizes = {r["tiles"]: r["n"] for r in blocks.groupBy("tiles").agg(F.sum("n").alias("n")).collect()}
    return feats.drop("_keys").join(kept, "id"), _rounds(sizes)


def _rounds(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """Ranges of the distance between the two sides of a tile, counted round the sides of its block.

    ``sizes`` has the rows of all blocks of so many tiles a side. At a distance a row is in one tile
    or two; a range holds as many distances as keep the rows of its tiles within ``ROUND_COPIES``
    times all rows, and one at least.
    """
    total, out, held = sum(sizes.values()), [], 0
    for d in range(max(sizes, default=0) // 2 + 1):
        rows = sum(n * (1 if d == 0 or 2 * d == t else 2) for t, n in sizes.items() if 2 * d <= t)
        if not out or held + rows > ROUND_COPIES * total:
            out.append((d, d))
            held = 0
        out[-1] = (out[-1][0], d)
        held += rows
    return out or [(0, 0)]


def _tiles(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows repeated once for each tile of each block they are in whose sides lie so far apart."""
    rows = (rows.withColumn("_k", F.explode("_kept")).filter(F.col("_k.tiles") >= 2 * first)
            .withColumn("key", F.col("_k.key")).withColumn("_t", F.col("_k.tiles"))
            .withColumn("keys", F.filter("_kept.key", lambda k: k < F.col("key"))).drop("_kept", "_k")
            .withColumn("side", F.pmod(F.xxhash64("id"), F.col("_t")).cast("int")))
    others = F.transform(F.sequence(F.lit(first), F.least(F.lit(last), F.floor(F.col("_t") / 2).cast("int"))), lambda d: F.array(
        F.pmod(F.col("side") + d, F.col("_t")), F.pmod(F.col("side") - d, F.col("_t"))))
    return (rows.withColumn("_j", F.explode(F.array_distinct(F.flatten(others))))
            .withColumn("lo", F.least("side", "_j")).withColumn("hi", F.greatest("side", "_j")).drop("_j", "_t"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers whose sums tell sets apart."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sets:
    """A column of sets. Rows of one class hold the same of those values that several rows hold, and equally many values."""

    def __init__(self, sets):
        n = len(sets)
        self.size = np.fromiter((len(x) for x in sets), dtype=np.int64, count=n)
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in sets if len(x))])
        _, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
        use = counts[code] > 1
        owner = np.repeat(np.arange(n), self.size)[use]
        self.code, self.start = code[use], np.searchsorted(owner, np.arange(n + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(self.code), dtype=np.uint64)])
        self.hash = total[self.start[1:]] - total[self.start[:-1]] + _mixed(self.size + (1 << 40))

    def classes(self, rows: np.ndarray):
        """(a row of each class, class of each row)."""
        _, first, of = np.unique(self.hash[rows], return_index=True, return_inverse=True)
        return rows[first], of

    def _values(self, rows):
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes)
        return self.code[at], np.repeat(np.arange(len(rows)), sizes)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of values that rows ``a`` share with other rows ``b``."""
        (va, oa), (vb, ob) = self._values(a), self._values(b)
        common = np.intersect1d(va, vb)
        if len(common) == 0:
            return np.zeros((len(a), len(b)))
        sides = []
        for values, owner, n in ((va, oa, len(a)), (vb, ob, len(b))):
            place = np.minimum(np.searchsorted(common, values), len(common) - 1)
            use = common[place] == values
            side = np.zeros((n, len(common)), dtype=np.float32)
            side[owner[use], place[use]] = 1
            sides.append(side)
        return (sides[0] @ sides[1].T).astype(float)


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros(np.broadcast_shapes(top.shape, bottom.shape)), where=bottom > 0)


# signals of sets, by the number of shared values and the sizes
_OF_SETS = {
    "folder_proximity": ("prefixes", lambda n, a, b: _ratio(n, np.minimum(a, b))),  # prefixes nest
    "shared_tags": ("tags", lambda n, a, b: _ratio(2.0 * n, a + b)),
    "shared_entities": ("ents", lambda n, a, b: _ratio(2.0 * n, a + b)),
    "filename_similarity": ("toks", lambda n, a, b: _ratio(n, a + b - n)),
    "shared_ai_category": ("cats", lambda n, a, b: n),
}


class _Tile:
    """Rows of one or several whole tiles; pairs are scored between pieces of at most CHUNK rows."""

    def __init__(self, rows: pd.DataFrame):
        cols = {c: rows[c].to_numpy() for c in rows.columns}
        self.cols, self.ids, self.n = cols, cols["id"], len(rows)
        cols["cats"] = [[c] if h else [] for c, h in zip(cols["cat"], cols["has_cat"])]
        # a pair in several blocks counts in the block with its smallest shared key
        cols["earlier"] = [ks[ks < k] for ks, k in zip(map(np.asarray, cols["keys"]), cols["key"])]
        self.sets = {c: _Sets(cols[c]) for c in ("prefixes", "tags", "ents", "toks", "cats", "approved", "rejected", "earlier")}
        self.ms = cols["ms"].astype(float)
        self.width = np.array([0 if v is None else len(v) for v in cols["vector"]])

    def pieces(self):
        """Pairs of pieces that hold all pairs of rows; off the diagonal of the tile grid, those across the two sides."""
        c = self.cols
        one = all((c[k] == c[k][0]).all() for k in ("key", "lo", "hi"))
        rows = np.arange(self.n)
        cut = lambda r: [r[i:i + CHUNK] for i in range(0, len(r), CHUNK)]
        if one and c["lo"][0] != c["hi"][0]:
            first = c["side"] == c["lo"][0]
            left, right = cut(rows[first]), cut(rows[~first])
            return [(a, b) for a in left for b in right]
        parts = cut(rows)
        return [(a, b) for i, a in enumerate(parts) for b in parts[i:]]

    def links(self, a: np.ndarray, b: np.ndarray):
        """(rows of a, rows of b, signals) of the linked pairs of two pieces."""
        of = {name: (self.sets[c].classes(a), self.sets[c].classes(b)) for name, (c, _) in _OF_SETS.items()}
        value = {}
        for name, (c, signal) in _OF_SETS.items():
            s, (ra, _), (rb, _) = self.sets[c], *of[name]
            value[name] = signal(s.shared(ra, rb), s.size[ra].astype(float)[:, None], s.size[rb].astype(float)[None, :])
        # an upper bound of each pair from two tables: folders, and all the rest by classes of the other sets;
        # texts count where both rows have a vector, dates always
        rest = [n for n in _OF_SETS if n != "folder_proximity"]
        kinds, kind = zip(*(np.unique(np.stack([*(of[n][side][1] for n in rest), self.width[r] > 0], 1), axis=0, return_inverse=True)
                            for side, r in enumerate((a, b))))
        bound = K.SIGNAL_WEIGHTS["semantic_similarity"] * (kinds[0][:, -1:] * kinds[1][:, -1])
        for k, n in enumerate(rest):
            bound = bound + K.SIGNAL_WEIGHTS[n] * value[n][kinds[0][:, k]][:, kinds[1][:, k]]
        folder = (K.SIGNAL_WEIGHTS["folder_proximity"] * value["folder_proximity"]).astype(np.float32)
        (_, fa), (_, fb) = of["folder_proximity"]
        pairs = bound.astype(np.float32)[kind[0].ravel()].take(kind[1].ravel(), axis=1)
        pairs += folder[fa].take(fb, axis=1)
        i, j = np.divmod(np.flatnonzero(pairs >= K.LINK_THRESHOLD - K.SIGNAL_WEIGHTS["date_proximity"] - 1e-4), len(b))
        at, to = a[i], b[j]
        ok = self.ids[at] != self.ids[to]
        if a[0] == b[0]:
            ok &= at < to
        c = self.cols
        for k in ("key", "lo", "hi"):
            ok &= c[k][at] == c[k][to]
        ok &= (c["lo"][at] == c["hi"][at]) | (c["side"][at] != c["side"][to])
        i, j, at, to = i[ok], j[ok], at[ok], to[ok]
        signals = [value[n][of[n][0][1][i], of[n][1][1][j]] for n in _OF_SETS]
        signals += [self._dates(at, to), self._meaning(a, b, i, j)]
        score = np.zeros(len(at))
        for weight, s in zip(K.SIGNAL_WEIGHTS.values(), signals):
            score += s * weight
        limit = np.where(self.common("rejected", a, b, i, j), K.LINK_THRESHOLD + K.REJECTED_EXTRA, K.LINK_THRESHOLD)
        link = np.flatnonzero((np.minimum(score, 1.0) >= limit) & ~self.common("approved", a, b, i, j))
        earlier = self.common("earlier", a, b, i[link], j[link])
        return at[link], to[link], ~earlier, [s[link] for s in signals]

    def common(self, name, a, b, i, j) -> np.ndarray:
        """Whether pairs share a value."""
        s = self.sets[name]
        (ra, ca), (rb, cb) = s.classes(a), s.classes(b)
        some = s.shared(ra, rb) > 0
        return some[ca[i], cb[j]] if some.any() else np.zeros(len(i), bool)

    def _dates(self, at, to):
        days = np.abs(self.ms[at] - self.ms[to]) / 86400000.0
        out = np.zeros(len(at))
        for limit, value in reversed(K.DATE_STEPS):
            out[days <= limit] = value
        return out

    def _meaning(self, a, b, i, j):
        out = np.zeros(len(i))
        wa, wb = self.width[a], self.width[b]
        for dim in np.intersect1d(wa[wa > 0], wb[wb > 0]):
            ia, ib = np.flatnonzero(wa == dim), np.flatnonzero(wb == dim)
            ma, mb = (np.vstack(self.cols["vector"][r]).astype(np.float64) for r in (a[ia], b[ib]))
            na, nb = (np.sqrt((m * m).sum(axis=1)) for m in (ma, mb))
            cos = np.clip(_ratio(ma @ mb.T, na[:, None] * nb[None, :]), 0.0, 1.0)
            use = np.flatnonzero((wa[i] == dim) & (wb[j] == dim))
            out[use] = cos[np.searchsorted(ia, i[use]), np.searchsorted(ib, j[use])]
        return out


def _joined(label: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Labels, each the least of its group, after joining the groups of given pairs."""
    while True:
        x, y = label[at], label[to]
        apart = x != y
        if not apart.any():
            return label
        at, to, x, y = at[apart], to[apart], x[apart], y[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


_TILE_OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("rep", T.LongType()),
                          T.StructField("links", T.LongType())]
                         + [T.StructField(s, T.DoubleType()) for s in SIGNALS])


def _score_tiles(rows: pd.DataFrame) -> list[tuple]:
    """Local groups and signal sums of one or several whole tiles."""
    tile = _Tile(rows)
    # files of one label are joined already
    by_rank, place = np.unique(tile.cols.get("label", tile.ids), return_inverse=True)
    n = len(by_rank)
    counts, sums = np.zeros(n), [np.zeros(n) for _ in SIGNALS]
    # the pairs of a piece are let go before the next one
    groups = np.arange(n)
    for a, b in tile.pieces():
        at, to, counted, signals = tile.links(a, b)
        if len(at) == 0:
            continue
        groups = _joined(groups, place[at], place[to])
        counts += np.bincount(place[at[counted]], minlength=n)
        for total, s in zip(sums, signals):
            total += np.bincount(place[at[counted]], weights=s[counted], minlength=n)
    none = (0.0,) * len(SIGNALS)
    out = [(int(by_rank[i]), int(by_rank[groups[i]]), 0) + none for i in np.flatnonzero(groups != np.arange(n))]
    counts = np.bincount(groups, weights=counts, minlength=n)
    sums = [np.bincount(groups, weights=s, minlength=n) for s in sums]
    out += [(int(by_rank[g]), int(by_rank[g]), int(counts[g])) + tuple(float(s[g]) for s in sums)
            for g in np.flatnonzero(counts)]
    return out


def _whole_tiles(rows: pd.DataFrame, at_least: int):
    """Cut rows sorted by tile into pieces of whole tiles of about ``at_least`` rows."""
    change = np.flatnonzero((rows[["key", "lo", "hi"]].to_numpy()[1:] != rows[["key", "lo", "hi"]].to_numpy()[:-1]).any(axis=1)) + 1
    start = 0
    before = 0
    for end in [*change, len(rows)]:
        if end - before >= at_least and before > start:  # a large tile goes alone
            yield rows.iloc[start:before]
            start = before
        if end - start >= at_least or end == len(rows):
            yield rows.iloc[start:end]
            start = end
        before = end


def link_groups(aug: DataFrame, projects: DataFrame | None = None, rejected: DataFrame | None = None,
                per_scan: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Local groups of linked findings: (id, rep, links, signal sums).

    Rows with id <> rep say the two belong together; rows with links > 0 carry the
    sums over that many linked pairs. ``projects`` and ``rejected`` are
    (group_id, finding_id): pairs in a common project are left alone, pairs in a
    common rejected candidate need a higher score.
    """
    # the features feed the block counts, the hot-key test and the tiles
    rows, rounds = _blocked(cut_lineage(_features(aug, projects, rejected, per_scan)), tile_rows)
    if len(rounds) == 1:
        return _linked(_tiles(rows.withColumn("label", F.col("id")), *rounds[0]))
    rows = write_table(rows, "rows")
    groups = labels = None
    for first, last in rounds:
        label = rows.withColumn("label", F.col("id")) if labels is None else (
            rows.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
            .withColumn("label", F.coalesce("component", "id")).drop("component"))
        found = write_table(_linked(_tiles(label, first, last)), "links")
        groups = found if groups is None else groups.unionByName(found)
        edges = found.filter("id <> rep").select("id", "rep")
        if last < rounds[-1][1] and not edges.isEmpty():
            known = edges if labels is None else edges.unionByName(labels.select(F.col("node").alias("id"), F.col("component").alias("rep")))
            labels = components(known)
    return groups


def _linked(tiles: DataFrame) -> DataFrame:
    """Local groups and signal sums of all tiles."""
    def run(batches):
        # tiles arrive sorted; the last tile of a batch may go on in the next
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if len(rows) == 0:
                continue
            tail = rows[["key", "lo", "hi"]].to_numpy()
            same = (tail == tail[-1]).all(axis=1)
            waiting = rows[same]
            yield from emit(rows[~same])
        if waiting is not None:
            yield from emit(waiting)

    def emit(rows):
        if len(rows):
            for piece in _whole_tiles(rows, SMALL_TILES):
                yield pd.DataFrame(_score_tiles(piece), columns=[f.name for f in _TILE_OUT])

    spark = tiles.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (tiles.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInPandas(run, _TILE_OUT))


# ---- components ----------------------------------------------------------------------

def components(edges: DataFrame, a: str = "id", b: str = "rep") -> DataFrame:
    """(node, component): smallest node id each node is connected to.

    Alternating large-star and small-star rounds. Minima are plain aggregates and
    neighbours of a hot node are spread over tasks; each round is checkpointed.
    """
    e = (edges.filter(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = cut_lineage(e)
    previous, size = None, e.count()
    while True:
        e = cut_lineage(_small_star(_large_star(e, size), size))
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == previous:
            break
        previous, size = (state["n"], state["h"]), state["n"]
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))


def _relink(pairs: DataFrame, total: int) -> DataFrame:
    """Join each (node, neighbour) with the least of node and its neighbours."""
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"), F.count("*").alias("n"))
    return join_hot(pairs, least, ["node"], "n", ["other"], total=max(total, 1))


def _large_star(e: DataFrame, size: int) -> DataFrame:
    both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        e.select(F.col("v").alias("node"), F.col("u").alias("other")))
    j = _relink(both, 2 * size).filter("other > node")
    return j.select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, size: int) -> DataFrame:
    j = _relink(e.select(F.col("u").alias("node"), F.col("v").alias("other")), size)
    moved = j.select(F.col("other").alias("u"), F.col("m").alias("v")).unionByName(
        j.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


# ---- candidates -------------------------------------------------------------------------

def cluster_signals(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """Mean of each signal over all linked pairs of a component, and its score."""
    sums = (groups.filter("links > 0").join(comps, F.col("rep") == F.col("node"))
            .groupBy("component").agg(F.sum("links").alias("link_count"),
                                      *[F.sum(s).alias(s) for s in SIGNALS]))
    means = F.struct(*[(F.col(s) / F.col("link_count")).alias(s) for s in SIGNALS])
    return (sums.select("component", "link_count", means.alias("signals"))
            .withColumn("score", signal_score(F.col("signals"))))


def explain(signals: Column) -> Column:
    """Explanation text of a signal struct."""
    parts = F.filter(F.array(*[F.when(signals[s] >= limit, F.lit(text)) for s, limit, text in K.SIGNAL_PHRASES]),
                     lambda x: x.isNotNull())
    rest = F.size(parts) - 1
    return (F.when(F.size(parts) == 0, K.WEAK_MATCH)
            .when(rest == 0, capitalise(F.get(parts, F.lit(0))))
            .otherwise(F.concat(capitalise(F.get(parts, F.lit(0))), F.lit(" and "), rest.cast("string"),
                                F.lit(" other "), plural("signal", rest))))


def dominant_folder(members: DataFrame, by: str = "component") -> DataFrame:
    """Most frequent folder segment per group, first seen wins ties."""
    segs = segments(F.col("path"))
    folders = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    seen = (members.select(by, "finding_id", F.posexplode(folders).alias("pos", "segment"))
            .groupBy(by, "segment").agg(F.count("*").alias("n"), F.min(F.struct("finding_id", "pos")).alias("first")))
    order = F.struct(F.col("n"), (-F.col("first.finding_id")).alias("a"), (-F.col("first.pos")).alias("b"))
    return seen.groupBy(by).agg(F.max_by("segment", order).alias("segment"))


def candidates(groups: DataFrame, comps: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate rows, member rows) of the components of linked findings."""
    members = findings.join(comps.withColumnRenamed("node", "finding_id"), "finding_id")
    head = members.groupBy("component").agg(F.count("*").alias("file_count"),
                                            F.min_by("name", "finding_id").alias("_first"))
    out = (cluster_signals(groups, comps).join(head, "component").join(dominant_folder(members), "component", "left"))
    named = F.when(F.col("segment").isNotNull() & ~F.col("segment").isin(".", "/"),
                   F.concat(F.lit("Project: "), F.col("segment"))).otherwise(
        F.concat(F.lit("Project: "), stem(F.col("_first")), F.lit(" ("), F.col("file_count").cast("string"), F.lit(" files)")))
    rows = (out.withColumn("name", named).withColumn("explanation", explain(F.col("signals")))
            .withColumn("status", F.lit("pending")).withColumnRenamed("component", "candidate_id")
            .drop("_first", "segment"))
    links = members.select(F.col("component").alias("candidate_id"), "finding_id")
    return rows, links


def generate_candidates(findings: DataFrame, tags: DataFrame, entities: DataFrame, chunks: DataFrame,
                        projects: DataFrame | None = None, rejected: DataFrame | None = None,
                        per_scan: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Project candidates and their members (G9, T8). Uncapped unless ``limit`` is given."""
    if limit is not None:
        findings = findings.orderBy("finding_id").limit(limit)
    aug = augment_findings(findings, tags, entities, chunks)
    groups = cut_lineage(link_groups(aug, projects, rejected, per_scan))
    return candidates(groups, components(groups), findings)


# ---- decisions ---------------------------------------------------------------------------

def apply_project_decisions(cands: DataFrame, members: DataFrame, decisions: DataFrame):
    """Approve, reject and merge candidates.

    ``decisions``: decision_id, action, candidate_id; a merge has one row per
    candidate. Returns (candidates, projects, project links, errors). A decision
    is refused as a whole if a candidate is unknown or not pending, or a merge
    names fewer than two.
    """
    d = decisions.distinct().join(cands.select("candidate_id", "name", "score", "explanation",
                                               F.col("status").alias("_s")), "candidate_id", "left")
    verdict = d.groupBy("decision_id").agg(
        F.min("action").alias("_a"), F.count("*").alias("_n"),
        F.bool_or(F.col("_s").isNull()).alias("_unknown"), F.bool_or(F.col("_s") != "pending").alias("_closed"))
    verdict = verdict.select("decision_id", "_n", F.when(F.col("_unknown"), "candidate not found")
                             .when(F.col("_closed"), "candidate is not pending")
                             .when(~F.col("_a").isin("approve", "reject", "merge"), "unknown action")
                             .when((F.col("_a") == "merge") & (F.col("_n") < 2), "a merge needs two candidates")
                             .alias("error"))
    ok = d.join(verdict.filter("error is null"), "decision_id").drop("error")
    errors = verdict.filter("error is not null").select("decision_id", "error")
    new_status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("merged")
    made = ok.filter("action <> 'reject'")
    projects = made.groupBy("decision_id", "action").agg(
        F.min_by("name", "candidate_id").alias("name"), F.avg("score").alias("confidence"),
        F.min_by("explanation", "candidate_id").alias("_e"), F.count("*").alias("_n"))
    projects = projects.select(
        F.col("decision_id").alias("project_id"), "name", "confidence",
        F.when(F.col("action") == "merge", F.format_string("Merged from %d candidates.", "_n")).otherwise(F.col("_e")).alias("explanation"),
        F.lit("active").alias("status"))
    links = (members.join(made.select("candidate_id", F.col("decision_id").alias("project_id")), "candidate_id")
             .select("project_id", "finding_id").distinct().withColumn("added_by", F.lit("auto")))
    changed = ok.select("candidate_id", new_status.alias("_new"),
                        F.when(F.col("action") != "reject", F.col("decision_id")).alias("project_id"))
    done = (cands.join(changed, "candidate_id", "left")
            .withColumn("status", F.coalesce("_new", "status")).drop("_new"))
    return done, projects, links, errors


def split_project(projects: DataFrame, links: DataFrame, moves: DataFrame):
    """Move files of a project into a new one (U4): (new projects, all links).

    ``moves``: project_id, finding_id, new_project_id, new_name.
    """
    gone = moves.select("project_id", "finding_id").distinct()
    made = (moves.select("project_id", "new_project_id", "new_name").distinct()
            .join(projects.select("project_id", "name", "confidence"), "project_id")
            .select(F.col("new_project_id").alias("project_id"), F.col("new_name").alias("name"), "confidence",
                    F.concat(F.lit('Split from project "'), F.col("name"), F.lit('"')).alias("explanation"),
                    F.lit("active").alias("status")))
    moved = (moves.join(projects.select("project_id"), "project_id", "left_semi")
             .select(F.col("new_project_id").alias("project_id"), "finding_id").distinct()
             .withColumn("added_by", F.lit("user")))
    kept = links.join(gone, ["project_id", "finding_id"], "left_anti")
    return made, kept.unionByName(moved)


# ---- project views -------------------------------------------------------------------------

def project_counts(projects: DataFrame, links: DataFrame, status: str | None = "active") -> DataFrame:
    """Projects with their number of files."""
    counts = links.groupBy("project_id").agg(F.count("*").alias("file_count"))
    shown = projects.filter(F.col("status") == status) if status else projects
    return shown.join(counts, "project_id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def candidate_members(cands: DataFrame, members: DataFrame, status: str | None = None) -> DataFrame:
    """Candidates with one row per member."""
    shown = cands.filter(F.col("status") == status) if status else cands
    n = members.groupBy("candidate_id").agg(F.count("*").alias("_n"))
    return join_hot(members, shown.join(n, "candidate_id"), ["candidate_id"], "_n", ["finding_id"]).drop("_n")


def project_file_matches(projects: DataFrame, links: DataFrame, findings: DataFrame, q: str) -> DataFrame:
    """Active projects holding a file whose name contains the text."""
    named = findings.filter(sql_like(F.col("name"), q)).select("finding_id")
    ids = links.join(named, "finding_id", "left_semi").select("project_id").distinct()
    return projects.filter("status = 'active'").join(ids, "project_id", "left_semi")


def matched_projects(direct: DataFrame, via_file: DataFrame) -> DataFrame:
    """Project ids matched either way, once each."""
    both = direct.select("project_id", F.lit(True).alias("d")).unionByName(
        via_file.select("project_id", F.lit(False).alias("d")))
    return both.groupBy("project_id").agg(F.bool_or("d").alias("direct"))


def search_projects(projects: DataFrame, links: DataFrame, findings: DataFrame, q: str) -> DataFrame:
    """Active projects matching by their texts or by a file name."""
    hit = F.lit(False)
    for c in ("name", "description", "explanation", "summary"):
        hit = hit | sql_like(F.coalesce(F.col(c), F.lit("")), q)
    direct = projects.filter("status = 'active'").filter(hit)
    ids = matched_projects(direct, project_file_matches(projects, links, findings, q))
    return (project_counts(projects, links).join(ids, "project_id")
            .withColumn("match_context", F.when(~F.col("direct"), "Matched via linked file"))
            .withColumn("confidence", F.round("confidence", 3)).drop("direct"))


def project_members(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Project id with the finding of each member."""
    return links.select("project_id", "finding_id").join(findings, "finding_id")


def project_facets(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct people, organisations and categories per project as rows.

    Hardly two members name the same person, so those rows are dealt out before they are told apart:
    the task that joins keeps no list of them.
    """
    people = (members.select("project_id", "finding_id")
              .join(entities.filter(F.col("type").isin("person", "organization") & (F.col("value") != "")), "finding_id")
              .select("project_id", F.col("type").alias("facet"), "value"))
    cats = members.filter("ai_category <> ''").select("project_id", F.lit("category").alias("facet"),
                                                      F.col("ai_category").alias("value"))
    return people.repartition("project_id", "facet", "value").distinct().unionByName(cats.distinct())


def project_timeline(members: DataFrame) -> DataFrame:
    """Members by date, unknown dates last (A13). Sorted by range, not per project in one task."""
    return (members.select("project_id", "finding_id", "name", "modified_at")
            .orderBy("project_id", F.asc_nulls_last("modified_at"), "finding_id"))


def project_rollup(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Per project: files, bytes, dates and facet counts."""
    base = members.groupBy("project_id").agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("storage_bytes"),
        F.min("modified_at").alias("first_date"), F.max("modified_at").alias("last_date"))
    facets = project_facets(members, entities).groupBy("project_id").agg(
        F.count_if(F.col("facet") == "person").alias("people"),
        F.count_if(F.col("facet") == "organization").alias("orgs"),
        F.count_if(F.col("facet") == "category").alias("categories"))
    return base.join(facets, "project_id", "left").fillna(0, ["people", "orgs", "categories"])


def project_categories(members: DataFrame) -> DataFrame:
    """Per project and category: files, bytes and share of the largest."""
    per = (members.filter("ai_category <> ''").groupBy("project_id", "ai_category")
           .agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("bytes")))
    top = per.groupBy("project_id").agg(F.greatest(F.max("bytes"), F.lit(1)).alias("_m"))
    return per.join(top, "project_id").withColumn("share", F.col("bytes") / F.col("_m")).drop("_m")
