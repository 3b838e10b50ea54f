"""Sum-of-squares packing of token pieces into sequences of fixed capacity.

Each piece goes to the open sequence, or a new one, that makes the sum over residual gaps of the
squared number of open sequences with that gap smallest. A task packs one share of the pieces and
keeps counts by gap only; shares grow in number with the pieces, not in size, so the loss from the
last open sequences of a share stays a fixed small part.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import token_stream
from .common import stored

CAPACITY = 4096
END = 1
#: Pieces of a share, about.
SHARE = 60_000


def library_encoder(path: str, group: int = 2000):
    """Encoder of pieces of text by the tokenizers library.

    Pieces go in one text, with a special token between them, whose id then parts their ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    mark_id, mark = min((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items())

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), group):
            part = pieces[at:at + group]
            text = mark.join(part)
            if text.count(mark) != len(part) - 1:  # a piece holds the mark itself
                out += [ids_of(p).tobytes() for p in part]
                continue
            ids = ids_of(text)
            ends = [*(np.flatnonzero(ids == mark_id) * 4).tolist(), len(ids) * 4]
            raw, start = ids.tobytes(), 0
            for end in ends:
                out.append(raw[start:end])
                start = end + 4
        return out
    return encode


@lru_cache(maxsize=1)
def worker_encoder(path: str):
    """Encoder of a file and the pieces it has met, kept by a Python worker from task to task."""
    return library_encoder(path), {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): a text's ids and an end id, cut at the capacity.

    Null and empty texts give the end id alone. ``with_ids`` adds the ids.
    """
    def run(batches):
        encode, met = worker_encoder(path)
        for part, rows in token_stream(batches, encode, cache=met):
            owner, number, start, length, crc, ids = [], [], [], [], [], []
            for r, tokens in enumerate(rows):
                tokens = np.append(tokens, np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(tokens), capacity)):
                    cut = tokens[at:at + capacity]
                    owner.append(r)
                    number.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        ids.append(cut.astype(np.int32))
            cols = [part.column(part.schema.get_field_index("doc_id")).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


class Sums:
    """Open sequences by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence number and offset for a piece; ties go to the tightest gap, and to an open sequence."""
        cap, n = self.capacity, self.count
        gap = cap
        if size < cap:
            have = n[size:cap]
            # change of the sum, halved, of moving one sequence from gap g to g - size
            change = np.where(have > 0, n[:cap - size] - have + 1.0, np.inf)
            if have[0] > 0:
                change[0] = 0.5 - have[0]
            best = int(change.argmin())
            if change[best] <= n[cap - size] + 0.5:
                gap = best + size
        if gap == cap:
            number, self.made = self.made, self.made + 1
        else:
            n[gap] -= 1
            number = self.open[gap].pop()
        if gap > size:
            n[gap - size] += 1
            self.open[gap - size].append(number)
        return number, cap - gap


def pack(cut: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to the capacity.

    Within a share the long pieces come first; rows alike in all columns are interchangeable, so
    a repeated task gives the same result.
    """
    cut = stored(cut, "pieces")
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    shares = max(1, -(-cut.count() // share))
    dealt = (cut.withColumn("_share", F.pmod(F.xxhash64(*keys), F.lit(shares)))
             .repartition(shares, "_share")
             .sortWithinPartitions("_share", F.col("length").desc(), *keys))

    def run(batches):
        now, sums = None, None
        for t in batches:
            part = t.column(t.schema.get_field_index("_share")).to_numpy()
            size = t.column(t.schema.get_field_index("length")).to_numpy()
            ids, offsets = [], []
            for p, s in zip(part.tolist(), size.tolist()):
                if p != now:
                    now, sums = p, Sums(capacity)
                number, offset = sums.place(s)
                ids.append((p << 36) + number)
                offsets.append(offset)
            kept = [i for i, n in enumerate(t.schema.names) if n != "_share"]
            yield pa.RecordBatch.from_arrays([*(t.column(i) for i in kept), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                                             names=[*(t.schema.names[i] for i in kept), "sequence_id", "offset"])

    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of each sequence, from packed pieces with ids; a sequence holds at most its capacity."""
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids")))
