"""Embedding, vector search and hybrid merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from filarium import constants as K
from filarium.functions import percent_text, strings
from filarium.operators.search import ask_once, batch_search, for_alike
from filarium.operators.skew import latest_wide, with_mark
from filarium.operators.textops import chunk_text
from filarium.session import cut_lineage

# Queries that meet a slice in one task, and of those the ones that are scored together, about.
QUERY_SHARE = 32768
QUERY_BLOCK = 4096
# Chunks of a slice, about: fewer for each core to have one; scores that a task holds at once.
CHUNK_SLICE = 65536
CHUNK_TILE = 8192
SCORES = 1 << 22
# Scores that are worked out one by one, at most; more of them are worked out as a whole tile.
FEW = 1 << 16
# Characters of the texts that are embedded together, about.
EMBED_CHARS = 1 << 20


def tokenize(text: Column) -> Column:
    """Lower-case tokens of two or more characters without stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9'-]+", " "), " ")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, "^['-]+|['-]+$", ""))
    stops = strings(K.STOP_WORDS)
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~F.array_contains(stops, t))


def term_frequency(df: DataFrame, key: str, text: str = "chunk_text") -> DataFrame:
    """(key, term, tf): occurrences of tokens and neighbouring token pairs."""
    toks = F.col("_t")
    pairs = F.when(F.size(toks) > 1, F.zip_with(F.slice(toks, F.lit(1), F.size(toks) - 1),
                                                F.slice(toks, F.lit(2), F.size(toks) - 1),
                                                lambda a, b: F.concat(a, F.lit(":"), b)))
    terms = F.concat(toks, F.coalesce(pairs, F.array().cast("array<string>")))
    return (df.select(key, tokenize(F.col(text)).alias("_t"))
            .select(key, F.explode(terms).alias("term"))
            .groupBy(key, "term").agg(F.count("*").alias("tf")))


def _packed(words) -> np.ndarray:
    """Words of up to eight letters as numbers."""
    return np.array([int.from_bytes(w.encode("ascii").ljust(8, b"\0"), "little") for w in words], np.uint64)


_LETTER, _INSIDE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_INSIDE[:] = _LETTER
_INSIDE[list(b"'-")] = True
_STOPS = np.sort(_packed(K.STOP_WORDS))


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the tokens of lower-case bytes: as ``tokenize`` finds them, whatever the bytes beyond ASCII."""
    letters = np.flatnonzero(_LETTER[data])
    if len(letters) == 0:
        return letters, letters
    # a token goes from the first to the last letter of a run of letters and marks
    gaps = np.cumsum(~_INSIDE[data])
    run = gaps[letters]
    cut = np.flatnonzero(run[1:] != run[:-1])
    start = letters[np.r_[0, cut + 1]]
    length = letters[np.r_[cut, len(letters) - 1]] + 1 - start
    key = np.zeros(len(start), np.uint64)
    for j in range(8):
        live = np.flatnonzero(length > j)
        key[live] |= data[start[live] + j].astype(np.uint64) << np.uint64(8 * j)
    stop = (length <= 8) & np.isin(key, _STOPS)
    use = (length >= 2) & ~stop
    return start[use], length[use]


def embed_batch(texts) -> np.ndarray:
    """Unit vectors of a batch of texts; a text without tokens has a zero vector.

    Texts are taken together up to EMBED_CHARS characters, so memory does not grow with the batch.
    """
    texts = list(texts)
    group = np.cumsum([len(t or "") for t in texts]) // EMBED_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return np.concatenate([_embed(texts[a:b]) for a, b in zip(cuts, cuts[1:])])


def _embed(texts: list) -> np.ndarray:
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(parts), K.EMBED_DIM))
    data = np.frombuffer(b" ".join(parts), np.uint8)
    start, length = _tokens(data)
    if len(start) == 0:
        return out.astype(np.float32)
    owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    follows = np.r_[False, owner[1:] == owner[:-1]]  # neighbours within a text
    order = np.argsort(-length, kind="stable")

    def hash_on(state: np.ndarray) -> np.ndarray:
        """Carry an FNV state for each token on over its characters, the longest tokens first."""
        state, at, size = state[order], start[order], -length[order]
        for j in range(int(length.max())):
            n = np.searchsorted(size, -j)  # tokens with more than j characters
            state[:n] = (state[:n] ^ data[at[:n] + j]) * np.uint32(K.FNV_PRIME)
        back = np.empty_like(state)
        back[order] = state
        return back

    word = hash_on(np.full(len(start), K.FNV_OFFSET, dtype=np.uint32))
    colon = (np.r_[word[:1], word[:-1]] ^ np.uint32(ord(":"))) * np.uint32(K.FNV_PRIME)
    first = np.concatenate([word, hash_on(colon)[follows]])
    owner = np.concatenate([owner, owner[follows]])
    second = first
    for ch in "_b":
        second = (second ^ np.uint32(ord(ch))) * np.uint32(K.FNV_PRIME)
    size = len(parts) * K.EMBED_DIM
    for bucket, weight in ((first, 1.0), (second, 0.5)):
        at = owner * K.EMBED_DIM + bucket % K.EMBED_DIM
        out += weight * np.bincount(at, minlength=size).reshape(out.shape)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_text(texts: pd.Series) -> pd.Series:
    """Hash embedding of a text, one Arrow batch at a time.

    The term-frequency weight is the same for a whole text up to its length, which
    the normalisation takes out again, so plain counts are enough.
    """
    return pd.Series(list(embed_batch(texts)), index=texts.index)


def embed_with(chunks: DataFrame, embedder: Column, model: str) -> DataFrame:
    """Attach vectors from any embedding column, e.g. a caller's pandas UDF (UD2)."""
    return (chunks.withColumn("vector", embedder).withColumn("model", F.lit(model))
            .withColumn("dimensionality", F.size("vector")))


def build_index(extracted: DataFrame, key: str = "finding_id", oldest: bool = False, lossless: bool = True) -> DataFrame:
    """Chunks and vectors of one extraction per finding."""
    picked = latest_wide(extracted, [key], ["created_at", "extracted_id"], oldest=oldest)
    chunks = chunk_text(picked, key, lossless).withColumn("chunk_id", F.xxhash64(key, "chunk_index"))
    return embed_with(chunks, embed_text(F.col("chunk_text")), K.EMBED_MODEL)


def index_coverage(extracted: DataFrame, index: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings indexed and skipped."""
    have = index.select(key, F.lit(1).alias("_i")).distinct()
    return (extracted.select(key).distinct().join(have, key, "left")
            .agg(F.count("_i").alias("indexed"), (F.count("*") - F.count("_i")).alias("skipped")))


def index_stats(index: DataFrame, key: str = "finding_id") -> DataFrame:
    """Chunks and embedded findings per stored model."""
    return index.groupBy("model").agg(F.count("*").alias("total_chunks"),
                                      F.count_distinct(key).alias("embedded_findings"))


def coverage(findings: DataFrame, other: DataFrame, key: str = "finding_id",
             missing: bool = False) -> DataFrame:
    """Findings with (or without) a row in another table."""
    return findings.join(other.select(key).distinct(), key, "left_anti" if missing else "left_semi")


def purge(table: DataFrame, ids: DataFrame | None = None, key: str = "finding_id") -> DataFrame:
    """Rows left after deleting those of the given findings, or all rows."""
    return table.limit(0) if ids is None else table.join(ids.select(key).distinct(), key, "left_anti")


# ---- search -------------------------------------------------------------------

_HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("finding_id", T.LongType()),
                      T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])
# scores count to this many decimals, so that equal texts tie
DECIMALS = 9


class _Top:
    """The best findings so far of a block of queries, each by its best chunk; ties go to smaller ids.

    Chunks come in the order of finding and chunk. Without ``k`` nothing is held back. Scores of single
    precision, with a bound of their error, tell which chunks may be good enough; only these are scored in full.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int | None, min_score: float):
        self.ids, self.queries, self.k = ids, queries, k
        self.floor = np.full(len(ids), np.nextafter(min_score, -np.inf))
        self.kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]  # query's place, finding, chunk, score
        self.cold = k is not None
        with np.errstate(over="ignore"):
            self.rough = queries.astype(np.float32)
            self.norm = np.sqrt((queries * queries).sum(axis=1))

    def add(self, findings: np.ndarray, chunks: np.ndarray, vectors: np.ndarray):
        step = max(1, SCORES // len(self.ids))
        for at in range(0, len(findings), step):
            yield from self._tile(findings[at:at + step], chunks[at:at + step], vectors[at:at + step])

    def _tile(self, findings, chunks, vectors):
        row, query = self._near(vectors)
        if row is None:
            scores = np.round(vectors @ self.queries.T, DECIMALS)
            fits = scores > self.floor
            if self.cold:
                starts = np.flatnonzero(np.r_[True, findings[1:] != findings[:-1]])
                if len(starts) > self.k:
                    top = np.maximum.reduceat(scores, starts, axis=0)
                    fits &= scores >= np.partition(top, len(starts) - self.k, axis=0)[len(starts) - self.k]
            self.cold = False
            row, query = np.nonzero(fits)
            score = scores[row, query]
        else:
            score = np.round(np.einsum("ij,ij->i", vectors[row], self.queries[query]), DECIMALS)
            fits = score > self.floor[query]
            row, query, score = row[fits], query[fits], score[fits]
        if len(row) == 0:
            return
        new = [query, findings[row], chunks[row], score]
        if self.k is None:
            yield self._rows(self._best(new))
            return
        # queries without anything new keep what they have
        some = np.zeros(len(self.ids), bool)
        some[query] = True
        held = some[self.kept[0]]
        rest = [x[~held] for x in self.kept]
        query, finding, chunk, score = self._best([np.concatenate([x[held], y]) for x, y in zip(self.kept, new)])
        order = np.lexsort((finding, -score, query))
        query, finding, chunk, score = query[order], finding[order], chunk[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]  # full: a later finding must be better
        self.kept = [np.concatenate([x, y[rank < self.k]]) for x, y in zip(rest, (query, finding, chunk, score))]

    def _near(self, vectors):
        """(row, query) of all pairs that may pass the floor; None for both where they are not few or not known."""
        if self.cold:
            return None, None
        with np.errstate(over="ignore", invalid="ignore"):
            longest = np.sqrt((vectors * vectors).sum(axis=1).max(initial=0))
            error = (vectors.shape[1] + 4) * 2.0 ** -22 * longest * self.norm + 10.0 ** -DECIMALS
            if not np.isfinite(error).all() or longest > 1e15 or self.norm.max(initial=0) > 1e15:
                return None, None
            # rounding the limit itself costs less than the error that is taken off twice
            limit = (self.floor - 2 * error - 1e-6 * np.abs(self.floor)).astype(np.float32)
            near = np.flatnonzero(vectors.astype(np.float32) @ self.rough.T > limit)
        return (None, None) if len(near) > FEW else np.divmod(near, len(self.ids))

    @staticmethod
    def _best(found: list[np.ndarray]) -> list[np.ndarray]:
        """The best chunk of each query and finding, the first of those with the best score."""
        query, finding, chunk, score = found
        order = np.lexsort((chunk, -score, finding, query))
        query, finding, chunk, score = query[order], finding[order], chunk[order], score[order]
        one = np.r_[True, (query[1:] != query[:-1]) | (finding[1:] != finding[:-1])]
        return [query[one], finding[one], chunk[one], score[one]]

    def _rows(self, kept) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[kept[0]]), *map(pa.array, kept[1:])], names=_HITS.names)

    def rows(self):
        for at in range(0, len(self.kept[0]), 10_000):
            yield self._rows([x[at:at + 10_000] for x in self.kept])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def score_chunks(chunks: DataFrame, queries: DataFrame, k: int | None, min_score: float) -> DataFrame:
    """Scored (query, finding, chunk) candidates for the best k findings (J19), or for all of them.

    ``chunks``: finding_id, chunk_id, vector. ``queries``: query_id, vector. Blocks of queries meet
    slices of findings in tasks; a task keeps the best k findings of each query over its whole
    slice, and a finding behind k others there is behind them overall. Vectors meet only those of
    their own length; missing and empty ones are skipped.
    """
    chunks = chunks.select("finding_id", "chunk_id", "vector").filter("size(vector) > 0")
    queries = queries.select("query_id", "vector").filter("size(vector) > 0")
    n, cores = chunks.count(), chunks.sparkSession.sparkContext.defaultParallelism
    blocks, slices = max(1, -(-queries.count() // QUERY_SHARE)), max(1, -(-n // CHUNK_SLICE), min(cores, -(-n // CHUNK_TILE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = (queries.select(F.size("vector").alias("width"), share("query_id", blocks).alias("block"), every(slices).alias("slice"), F.lit(0).alias("role"),
                           F.col("query_id").cast("bigint").alias("finding_id"), F.lit(0).cast("bigint").alias("chunk_id"), "vector")
            .union(chunks.select(F.size("vector"), every(blocks), share("finding_id", slices), F.lit(1),
                                 F.col("finding_id").cast("bigint"), F.col("chunk_id").cast("bigint"), "vector")))
    # several partitions for each cell, so that few meet in one task
    rows = (rows.withColumn("cell", F.xxhash64("width", "block", "slice")).repartition(4 * blocks * slices, "cell")
            .sortWithinPartitions("width", "block", "slice", "role", "finding_id", "chunk_id"))

    def run(batches):
        now, asked, open_ = None, [], []
        for t in batches:
            keys = np.stack([t.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                cell, part = tuple(keys[a][:3].tolist()), t.slice(a, b - a)
                if cell != now:
                    for top in open_:
                        yield from top.rows()
                    now, asked, open_ = cell, [], []
                ids, more, vectors = part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6), part.num_rows)
                if keys[a][3] == 0:
                    asked.append((ids, vectors))
                elif asked or open_:
                    if not open_:
                        of, wanted = map(np.concatenate, zip(*asked))
                        open_ = [_Top(of[i:i + QUERY_BLOCK], wanted[i:i + QUERY_BLOCK], k, min_score) for i in range(0, len(of), QUERY_BLOCK)]
                        asked = []
                    for top in open_:
                        yield from top.add(ids, more, vectors)
        for top in open_:
            yield from top.rows()

    return rows.drop("cell").mapInArrow(run, _HITS)


def best_chunk(hits: DataFrame) -> DataFrame:
    """Best chunk per query and finding (W2): higher score, then smaller chunk id."""
    best = F.max_by(F.struct("chunk_id", "score"), F.struct(F.col("score"), (-F.col("chunk_id")).alias("o")))
    return (hits.groupBy("query_id", "finding_id").agg(best.alias("b"))
            .select("query_id", "finding_id", "b.chunk_id", "b.score"))


def top_hits(hits: DataFrame, k: int = K.SEMANTIC_TOP_K, min_score: float = K.SEMANTIC_MIN_SCORE,
             score: str = "score") -> DataFrame:
    """Best k findings per query (T3). The rank limit also runs before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "finding_id")
    return (hits.filter(F.col(score) >= min_score)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def semantic_search(index: DataFrame, queries: DataFrame, k: int = K.SEMANTIC_TOP_K,
                    min_score: float = K.SEMANTIC_MIN_SCORE) -> DataFrame:
    """Top findings per query by their best chunk."""
    return top_hits(best_chunk(score_chunks(index, queries, k, min_score)), k, min_score)


def search_texts(index: DataFrame, queries: DataFrame, k: int = K.SEMANTIC_TOP_K, min_score: float = K.SEMANTIC_MIN_SCORE,
                 embedder: Column | None = None) -> DataFrame:
    """Top findings of each query text, with the passage that matched and its model.

    ``index`` as ``build_index`` makes it; ``queries``: query_id, query. The texts are embedded as the index
    was; ``embedder`` is a column over ``query`` for another model. A text without tokens has no hits.
    """
    asked, alike = ask_once(queries.select("query_id", "query"))
    return for_alike(_search_asked(index, asked, k, min_score, embedder), alike)


def _search_asked(index: DataFrame, asked: DataFrame, k: int, min_score: float, embedder: Column | None = None) -> DataFrame:
    asked = cut_lineage(asked.select("query_id", (embed_text(F.col("query")) if embedder is None else embedder).alias("vector")))
    place = F.col("chunk_index").cast("bigint").alias("chunk_id")
    hits = cut_lineage(semantic_search(index.select("finding_id", place, "vector"), asked, k, min_score))
    found = ["finding_id", "chunk_id"]
    # passages that no query found stay where they are read
    passages = with_mark(index.select("finding_id", place, F.col("chunk_text").alias("passage"), "model"), hits.select(*found), found)
    passages = passages.filter("_marked").drop("_marked")
    return hits.join(passages, found).withColumnRenamed("chunk_id", "chunk_index")


def hybrid_search(interpreted: DataFrame, findings: DataFrame, entities: DataFrame, index: DataFrame, hybrid: bool = True,
                  lexical_limit: int = 100, k: int = K.SEMANTIC_TOP_K, min_score: float = K.SEMANTIC_MIN_SCORE) -> DataFrame:
    """Filtered search and search of texts in one list for every query of a table.

    ``interpreted`` as ``interpret_queries`` makes it. The first ``lexical_limit`` findings of a query's filtered
    search count by their place, the ``k`` best of the texts by their score. Findings of the filtered search
    alone have no passage and no model. Without ``hybrid`` only hits of the texts are listed.
    """
    asked, alike = ask_once(cut_lineage(interpreted))
    listed = batch_search(asked, findings, entities, lexical_limit).select("query_id", "finding_id", "position")
    lexical = rank_score(listed, ["position"])
    merged = hybrid_merge(lexical, _search_asked(index, asked.select("query_id", "query"), k, min_score), hybrid, k)
    return for_alike(cut_lineage(merged), alike)


def rank_score(ranked: DataFrame, order: list, by: str = "query_id") -> DataFrame:
    """Linear rank score of an already limited result list per query."""
    w = Window.partitionBy(by)
    pos = F.row_number().over(w.orderBy(*order)) - 1
    return ranked.withColumn("lexical_score", 1 - pos / F.count("*").over(w))


def hybrid_merge(lexical: DataFrame, semantic: DataFrame, hybrid: bool = True,
                 k: int = K.SEMANTIC_TOP_K) -> DataFrame:
    """Blend ranked lexical results with semantic hits.

    ``lexical``: query_id, finding_id, lexical_score. ``semantic``: query_id,
    finding_id, score and what else belongs to a hit.
    """
    lex = lexical.select("query_id", "finding_id", "lexical_score")
    both = semantic.drop("rank").join(lex, ["query_id", "finding_id"], "full_outer" if hybrid else "left")
    sem, lx = F.coalesce("score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0))
    combined = sem * K.SEMANTIC_WEIGHT + lx * K.LEXICAL_WEIGHT if hybrid else sem
    merged = (both.withColumn("semantic_score", sem).withColumn("lexical_score", lx)
              .withColumn("combined_score", combined).drop("score"))
    return top_hits(merged, k, float("-inf"), "combined_score")


def format_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scores at four decimals, each with its percent text."""
    for c in columns:
        df = df.withColumn(f"{c}_text", percent_text(F.col(c))).withColumn(c, F.round(c, 4))
    return df
