"""Byte-pair encoding of whole texts, and decoding.

Texts are cut at ASCII white space, which the tokenizer drops, so a piece encodes alone and a task
encodes each distinct piece once. A word keeps a segment tree over the ranks of its adjacent
pairs: the root is the leftmost pair of lowest rank; a merge changes three leaves and their
paths; it ends when the root holds no mergeable pair. Trees of words of like length lie side by
side in one array and step together.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

_BATCH_CHARS = 1 << 23
_CACHE_WORDS, _CACHE_CHARS = 500_000, 48
_TREES = 1 << 21
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, new = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], new = chr(new), new + 1
    return [out[b] for b in range(256)]


class Bpe:
    """Vocabulary and merges of a tokenizer file with word ends, lower case and byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        steps = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.split = regex.compile(steps[0])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.width = len(self.tokens)
        left, right, made = [], [], []
        for a, b in model["merges"]:
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)

    def words(self, piece: str) -> list[str | int]:
        """Words of a piece of text, special tokens as their ids."""
        out: list[str | int] = []
        for part in self.marks.split(piece) if "<|" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part)
                # letter by letter: a sigma at the end of a word is no exception
                low = "".join(map(str.lower, plain)) if "Σ" in plain else plain.lower()
                out += self.split.findall(low)
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(d) for d in data])
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        width = 1
        while len(data) and width < 2 * max(1, sizes.max()):
            rows = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            step = max(1, _TREES // width)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for r, ids in zip(part.tolist(), self._merge([data[r] for r in part], sizes[part], width)):
                    out[r] = ids
            width *= 2
        return out

    def _merge(self, data: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
        n = len(data)
        raw = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sym = np.full((n, width + 1), -1, np.int64)
        sym[row, col] = self.inner[raw]
        ends = np.arange(n), sizes - 1
        sym[ends] = self.last[raw[np.cumsum(sizes) - 1]]
        place = np.arange(width + 1)
        after = np.minimum(place + 1, width)[None].repeat(n, 0)
        before = (place - 1)[None].repeat(n, 0)
        after[ends] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        if width > 1:
            a, b = sym[:, :width - 1], sym[:, 1:width]
            rank = np.where(b >= 0, self._rank(a, b), -1)
            tree[:, width:2 * width - 1] = np.where(rank >= 0, rank * width + place[:width - 1], NONE)
            level = width // 2
            while level:
                tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
                level //= 2
            live = np.flatnonzero(tree[:, 1] < NONE)
            while len(live):
                rank, at = np.divmod(tree[live, 1], width)
                gone = after[live, at]
                sym[live, at] = self.made[rank]
                sym[live, gone] = -1
                nxt, prev = after[live, gone], before[live, at]
                after[live, at] = nxt
                before[live, nxt] = at
                self._leaf(tree, live, gone, np.full(len(live), NONE), width)
                self._leaf(tree, live, at, self._key(sym, live, at, nxt, width), width)
                some = prev >= 0
                self._leaf(tree, live[some], prev[some], self._key(sym, live[some], prev[some], at[some], width), width)
                live = live[tree[live, 1] < NONE]
        sym = sym[:, :width]
        flat = sym[sym >= 0]
        return np.split(flat, np.cumsum((sym >= 0).sum(axis=1))[:-1])

    def _key(self, sym, rows, at, nxt, width):
        b = sym[rows, nxt]
        rank = np.where(b >= 0, self._rank(sym[rows, at], b), -1)
        return np.where(rank >= 0, rank * width + at, NONE)

    @staticmethod
    def _leaf(tree, rows, at, key, width):
        node = at + width
        tree[rows, node] = key
        while len(node) and node[0] > 1:
            node = node // 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        cut = [self.words(p) for p in pieces]
        distinct = list(dict.fromkeys(w for ws in cut for w in ws if isinstance(w, str)))
        ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in self.encode_words(distinct))))
        return [b"".join(ids[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in ws) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens of ids, special ones included, with a space between them."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _plainer(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct pieces: a space between an ASCII letter and a mark, ASCII lower case.

    A letter and a mark never share a word. Case waits where a special token or a combining mark
    could come of it.
    """
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([A-Za-z])([.,;:!?])", r"\1 \2")
    if pc.any(pc.match_substring_regex(texts, "<\\||[\\x{0300}-\\x{036F}]")).as_py():
        return texts
    return pc.ascii_lower(texts)


def token_stream(batches, encode: Callable[[list[str]], list[bytes]], name: str = "text",
                 cache: dict[str, bytes] | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of bounded size with the ids of each row's whole text; null counts as empty.

    ``encode`` takes pieces without ASCII white space. Short pieces are kept for later batches,
    and in a given ``cache`` for later calls with the same encoder.
    """
    cache = {} if cache is None else cache
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // _BATCH_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
        for a, b in zip(cuts, cuts[1:]):
            lists = pc.ascii_split_whitespace(_plainer(column.slice(a, b - a)))
            coded = lists.flatten().dictionary_encode()
            pieces, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            new = [p for p in pieces if p not in cache]
            if len(cache) + len(new) > _CACHE_WORDS:
                cache.clear()
                new = pieces
            fresh = dict(zip(new, encode(new)))
            ids = [fresh[p] if p in fresh else cache[p] for p in pieces]
            cache.update((p, v) for p, v in fresh.items() if len(p) <= _CACHE_CHARS)
            flat = np.frombuffer(b"".join(ids), "<u4")
            size = np.array([len(x) // 4 for x in ids], np.int64)
            start = np.cumsum(size) - size
            many = size[index]
            stop = np.cumsum(many)
            stream = flat[np.repeat(start[index] - (stop - many), many) + np.arange(stop[-1] if len(stop) else 0)]
            offsets = lists.offsets.to_numpy()
            edges = np.concatenate([[0], stop])[offsets - offsets[0]]
            yield batch.slice(a, b - a), [stream[x:y] for x, y in zip(edges, edges[1:])]


def encode_table(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded text if asked for.

    ``path`` names the tokenizer file, which every executor must be able to read.
    """
    def run(batches):
        bpe = Bpe(path)
        for part, rows in token_stream(batches, bpe.encode_pieces):
            decoded = [bpe.decode(r) for r in rows]
            cols = [part.column(part.schema.get_field_index("doc_id")), pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(np.ascontiguousarray(r)).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
