"""Alignment of the tokens of two tokenizers, and links of their ids.

A text's tokens under both tokenizers are cut into groups at the byte offsets where a token of each
ends. Most groups hold one token of each with the same bytes: an array from A ids to the B ids of
the same bytes tells them apart, and a vector of the vocabulary's length counts them. Only pairs of
the other groups are shuffled to be counted.

Texts are cut into words where a blank or a line feed follows another character than white space:
neither tokenizer has a token across such a place, so a task aligns each distinct word once. A
block is a run of texts with its own numbers for words and pairs, of bounded size. Counts of pairs
come back to the blocks that hold them, and a pass over each block sums them by text.

Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros and
an empty digest. Rows of one doc_id are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_letters
from .common import stored

#: White space of Unicode but for blank and line feed.
OTHER_SPACES = "\t\x0b\x0c\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
SPACES = " \n" + OTHER_SPACES
WORDS = re.compile(f"[{SPACES}]*[^{SPACES}]*(?:[{OTHER_SPACES}][{SPACES}]*[^{SPACES}]*)*")
#: Characters that are read before their new words are aligned; distinct words, and all words, of a block, about.
_READ, _DISTINCT, _ALL = 1 << 21, 300_000, 4_000_000
#: Words that go to a tokenizer in one text.
_GROUP = 2000


class ByteBpe:
    """A byte-level tokenizer file of the tokenizers library; marks of special tokens count as plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = {t["content"]: t["id"] for t in spec["added_tokens"]} | spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token if c in byte)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class PieceBpe:
    """A sentencepiece model that puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        if any(re.search(rb"[^ ] |\n.|.\n", b, re.DOTALL) for b in self.bytes):
            raise ValueError("a piece reaches over the end of a word")
        self.blank = self.model.piece_to_id("▁")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a blank or a line feed."""
        if text == " ":
            return np.array([self.blank], np.int64)
        ids = self.model.encode(text[1:] if text[0] == " " else text)
        return np.array(ids if text[0] == " " else ids[1:], np.int64)  # before a line feed the blank stands alone


def words(text: str | None) -> list[str]:
    """Words of a blank and the text, with the white space before them; none for null and empty."""
    return [w for w in WORDS.findall(" " + text) if w] if text else []


class Aligner:
    """Both tokenizers, the array from A ids to B ids of the same bytes, and texts of ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        first: dict[bytes, int] = {}
        for i, x in enumerate(self.b.bytes):
            first.setdefault(x, i)
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.a.bytes], np.int64)
        self.len_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.len_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.wide = len(self.b.bytes)
        # an id's text inside and at the end of its side of a group
        self.text = [f"{i}{end}" for n, ends in ((len(self.a.bytes), ",|"), (self.wide, ",;")) for end in ends for i in range(n)]

    def _encode(self, part: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of words; words that end in white space, or don't come back, go alone."""
        together = [w for w in part if w[0] in " \n" and w[-1] not in SPACES]
        ids: dict[str, tuple] = {}
        for at in range(0, len(together), _GROUP):
            some = together[at:at + _GROUP]
            raw = [w.encode() for w in some]
            whole, data = "".join(some), b"".join(raw)
            a, b = self.a.encode(whole), self.b.encode(whole)
            if any(b"".join(map(t.bytes.__getitem__, x.tolist())) != data for t, x in ((self.a, a), (self.b, b))):
                continue
            ends = np.cumsum([len(r) for r in raw])
            cut_a = np.searchsorted(np.cumsum(self.len_a[a]), ends, "right")
            cut_b = np.searchsorted(np.cumsum(self.len_b[b]), ends, "right")
            ids.update(zip(some, zip(np.split(a, cut_a[:-1]), np.split(b, cut_b[:-1]))))
        out_a, out_b, fine = [], [], []
        for w in part:
            a, b = ids[w] if w in ids else (self.a.encode(w), self.b.encode(w))
            ok = w in ids or all(b"".join(map(t.bytes.__getitem__, x.tolist())) == w.encode() for t, x in ((self.a, a), (self.b, b)))
            out_a.append(a if ok else a[:0])
            out_b.append(b if ok else b[:0])
            fine.append(ok)
        return out_a, out_b, fine

    def align(self, part: list[str]) -> Aligned:
        out_a, out_b, fine = self._encode(part)
        n_a, n_b = np.array([len(x) for x in out_a], np.int64), np.array([len(x) for x in out_b], np.int64)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (out_a, out_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        common = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        # between two ends lies one token of each side: that is a link
        word = np.repeat(np.arange(len(part)), n_a)[at_a]
        link_a, link_b = a[at_a], b[at_b]
        plain = common & (self.len_a[link_a] == self.len_b[link_b]) & (self.same[link_a] == link_b)
        stops = ends[common]
        group_a, group_b = np.searchsorted(stops, end_a), np.searchsorted(stops, end_b)
        last_a, last_b = (np.isin(x, stops, assume_unique=True) for x in (end_a, end_b))
        n = len(self.a.bytes)
        codes = np.concatenate([a + n * last_a, b + 2 * n + self.wide * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts, cuts = list(map(self.text.__getitem__, codes[order].tolist())), [0, *np.cumsum(n_a + n_b).tolist()]
        return Aligned(n_a, n_b, np.bincount(word[common], minlength=len(part)), np.bincount(word, minlength=len(part)),
                       np.array(fine, bool), ["".join(texts[x:y]) for x, y in zip(cuts, cuts[1:])],
                       np.where(plain, link_a, -1), link_a * self.wide + link_b)


class Aligned:
    """Of words: numbers of tokens, groups and links, whether they come back, texts of groups; of links: the A id if plain, and the pair."""

    def __init__(self, *parts):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.fine, self.texts, self.plain, self.pair = parts

    def __add__(self, other: Aligned) -> Aligned:
        mine, others = vars(self).values(), vars(other).values()
        return Aligned(*(x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(mine, others)))


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


SCHEMA = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()),
                    ("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                    ("groups_sha256", pa.string()), ("codes", pa.binary()), ("sizes", pa.binary())])
#: Roles of rows: a pair of a block, the words of a block, a text, an A id of the vector.
PAIR, WORD, TEXT, PLAIN = range(4)


def _batch(rows: int, /, **columns) -> pa.RecordBatch:
    full = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in SCHEMA]
    return pa.RecordBatch.from_arrays(full, schema=SCHEMA)


class _Block:
    """Texts of a block, its words and how often they come."""

    def __init__(self, aligner: Aligner, number: int):
        self.aligner, self.number = aligner, number
        self.numbers, self.known, self.count, self.all = _Numbers(), aligner.align([]), np.zeros(0, np.int64), 0

    def texts(self, docs: list[int], cut: list[list[str]]) -> pa.RecordBatch:
        codes = [np.array(list(map(self.numbers.__getitem__, ws)), np.int64) for ws in cut]
        new = list(self.numbers)[len(self.known.texts):] if len(self.numbers) > len(self.known.texts) else []
        if new:
            self.known = self.known + self.aligner.align(new)
        k = self.known
        codes = [c if k.fine[c].all() else c[:0] for c in codes]
        flat, edges = np.concatenate([np.zeros(0, np.int64), *codes]), np.cumsum([0, *map(len, codes)])
        seen = np.bincount(flat, minlength=len(k.fine))
        seen[:len(self.count)] += self.count
        self.count = seen
        self.all += len(flat)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[flat])])[edges])
        digests = [hashlib.sha256("".join(map(k.texts.__getitem__, c.tolist()))[:-1].encode()).hexdigest() if len(c) else "" for c in codes]
        return _batch(len(docs), block=np.full(len(docs), self.number), role=np.full(len(docs), TEXT), doc=docs, n_a=total(k.n_a), n_b=total(k.n_b),
                      n_groups=total(k.n_groups), n_links=total(k.n_links), groups_sha256=digests, codes=[c.astype("<u4").tobytes() for c in codes])

    def close(self, vector: np.ndarray):
        """Rows of the block's pairs and words; plain links are added to the vector."""
        k = self.known
        weight = np.repeat(self.count, k.n_links)
        plain = k.plain >= 0
        np.add.at(vector, k.plain[plain], weight[plain])
        pairs, place = np.unique(k.pair[~plain], return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, place, weight[~plain])
        codes = k.plain.copy()
        codes[~plain] = len(self.aligner.a.bytes) + place
        for at in range(0, len(pairs), 10_000):
            key = pairs[at:at + 10_000]
            yield _batch(len(key), block=np.full(len(key), self.number), role=np.full(len(key), PAIR), at=np.arange(at, at + len(key)),
                         a=key // self.aligner.wide, b=key % self.aligner.wide, n=n[at:at + 10_000])
        yield _batch(1, block=[self.number], role=[WORD], codes=[codes.astype("<u4").tobytes()], sizes=[k.n_links.astype("<u4").tobytes()])


def _encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of all roles for rows (doc, text)."""
    def run(batches):
        aligner = Aligner(path_a, path_b)
        vector = np.zeros(len(aligner.a.bytes), np.int64)
        number = TaskContext.get().partitionId() << 32
        block = _Block(aligner, number)
        for t in batches:
            ids, texts = t.column(0).to_pylist(), t.column(1)
            some_ids, some, read = [], [], 0
            for i, at in enumerate(ids):
                text = texts[i].as_py()
                some_ids.append(at)
                some.append(words(text))
                read += len(text or "")
                if read >= _READ or i == len(ids) - 1:
                    yield block.texts(some_ids, some)
                    some_ids, some, read = [], [], 0
                    if len(block.numbers) >= _DISTINCT or block.all >= _ALL:
                        yield from block.close(vector)
                        number += 1
                        block = _Block(aligner, number)
        yield from block.close(vector)
        some = np.flatnonzero(vector)
        for at in range(0, len(some), 10_000):
            a = some[at:at + 10_000]
            yield _batch(len(a), role=np.full(len(a), PLAIN), a=a, b=aligner.same[a], n=vector[a])

    schema = ("block long, role int, at int, a int, b int, n long, doc long, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, codes binary, sizes binary")
    return docs.mapInArrow(run, schema)


def link_counts(encoded: DataFrame) -> DataFrame:
    """Rows (a, b, n, best): how many links hold an id pair, and whether that is the most of its B id, ties included."""
    n = encoded.where(F.col("role").isin(PAIR, PLAIN)).groupBy("a", "b").agg(F.sum("n").alias("n"))
    n = stored(n.where("n > 0"), "links")
    most = n.groupBy("b").agg(F.max("n").alias("most"))  # at most one row for each B id
    return n.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def encode_pairs(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``align`` and those of ``link_counts``; the files must be readable on every executor."""
    spark = docs.sparkSession
    encoded = stored(_encoded(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), path_a, path_b), "encoded")
    counts = stored(link_counts(encoded), "counts")
    plain = encoded.where(F.col("role") == PLAIN).select("a", "b").distinct()
    fast = counts.join(plain, ["a", "b"]).select("a", "n", "best").toArrow()  # at most one row for each A id
    a = fast.column("a").to_numpy()
    n, best = np.zeros(1 + max([-1, *a.tolist()]), np.int64), np.zeros(1 + max([-1, *a.tolist()]), np.int64)
    n[a], best[a] = fast.column("n").to_numpy(), fast.column("best").to_numpy(zero_copy_only=False)
    vectors = spark.sparkContext.broadcast((n, best))
    size_a = len(ByteBpe(path_a).bytes)
    back = (encoded.where(F.col("role") == PAIR).select("block", "at", "a", "b").join(counts, ["a", "b"], "left")
            .select("block", F.lit(PAIR).alias("role"), "at", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce(F.col("best").cast("int"), F.lit(0)).alias("best"),
                    *(F.lit(None).cast(t).alias(c) for c, t in (("doc", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"),
                                                                ("groups_sha256", "string"), ("codes", "binary"), ("sizes", "binary")))))
    rest = encoded.where(F.col("role").isin(WORD, TEXT)).select(
        "block", "role", "at", "n", F.lit(0).alias("best"), "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "sizes")
    rows = back.union(rest).repartition("block").sortWithinPartitions("block", "role", "at")

    def run(batches):
        now, counts_, bests = None, [], []
        word_n = word_best = np.zeros(0, np.int64)
        n, best = vectors.value
        n, best = (np.concatenate([x, np.zeros(size_a - len(x), np.int64)]) for x in (n, best))
        for t in batches:
            keys = np.stack([t.column(0).to_numpy(), t.column(1).to_numpy().astype(np.int64)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for x, y in zip(cuts, cuts[1:]):
                (block, role), part = keys[x].tolist(), t.slice(x, y - x)
                if block != now:
                    now, counts_, bests = block, [], []
                if role == PAIR:
                    counts_.append(part.column(3).to_numpy())
                    bests.append(part.column(4).to_numpy().astype(np.int64))
                elif role == WORD:
                    links, sizes = (np.frombuffer(part.column(c)[0].as_py(), "<u4").astype(np.int64) for c in (11, 12))
                    edges = np.concatenate([[0], np.cumsum(sizes)])
                    word_n, word_best = (np.diff(np.concatenate([[0], np.cumsum(np.concatenate([v, *own])[links])])[edges])
                                         for v, own in ((n, counts_), (best, bests)))
                else:
                    raw = part.column(11).to_pylist()
                    codes = np.frombuffer(b"".join(raw), "<u4")
                    edges = np.cumsum([0, *(len(r) // 4 for r in raw)])
                    sums = [np.diff(np.concatenate([[0], np.cumsum(v[codes])])[edges]) for v in (word_best, word_n)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (5, 6, 7, 8, 9)), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
                                                      part.column(10)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), counts


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each document.

    ``n_best`` counts links whose id pair has the highest count of all pairs with its B id; ``count_sum`` adds
    up the counts of the pairs of all links.
    """
    return encode_pairs(docs, path_a, path_b)[0]
