"""Bounded-space online best-fit packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import text_of
from .tokens import Ids

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole unless longer than
    ``capacity``, else full pieces behind a first piece that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class OpenBins:
    """At most ``limit`` open bins, in a bitset keyed by free space.

    ``place`` puts a piece where it leaves least room. If none fits and all
    places are taken, the fullest bin closes first.
    """

    def __init__(self, capacity: int, limit: int, first_id: int = 0):
        self.capacity, self.limit, self.bits, self.n, self.next = capacity, limit, 0, 0, first_id
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.at[free]
        bin_id = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.n -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``size``, at most the capacity."""
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next
            self.next += 1
        left = free - size
        if left:
            if self.n >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest >= left:  # the bin at hand is itself the fullest
                    return bin_id, self.capacity - free
                self._take(fullest)
            self.at[left].append(bin_id)
            self.bits |= 1 << left
            self.n += 1
        return bin_id, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text), eos], dtype="<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows)) or [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, from_arrow_schema(PIECES))


def pack(rows: DataFrame, shards: int, capacity: int = 1024, open_bins: int = 4096, waves: int = 8) -> DataFrame:
    """Place pieces (``pieces``' columns) into sequences; adds sequence_id and offset.

    Pieces are dealt to ``shards`` by a hash of doc_id and their place in the
    table, so that no id of many rows fills one. The order of arrival is that of
    a sort: ``waves`` waves by another such hash, and in each the longest pieces
    first, which leaves less room than other orders. Each piece is placed as it
    arrives, whatever batch it comes in; a shard holds only the open bins.
    Sequence numbers are unique over all shards. Repeated rows are packed once
    each; a null doc_id is a value like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            put = list(zip(*map(bins.place, batch.column(3).to_pylist()))) or [[], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(put[0], pa.int64()), pa.array(put[1], pa.int64())], schema=PLACED)

    dealt = rows.withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id())).repartition(shards, "deal")
    wave = F.pmod(F.xxhash64("deal"), F.lit(waves))
    return dealt.sortWithinPartitions(wave, F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(run, from_arrow_schema(PLACED))


def packed(docs: DataFrame, tokenizer: str, capacity: int = 1024, eos: int = 2, open_bins: int = 4096, docs_per_shard: int = 50_000) -> DataFrame:
    """Tokenize whole documents and pack them into sequences of ``capacity``.

    docs: doc_id, text (null: empty); other columns are ignored. Each document
    is its ids and then ``eos``. Only documents longer than the capacity are
    cut. An empty table gives an empty result; an empty text is one piece that
    holds ``eos`` alone. The ids stay in their task: only lengths are shuffled.
    """
    shards = max(1, -(-docs.count() // docs_per_shard))
    return pack(pieces(docs, tokenizer, capacity, eos), shards, capacity, open_bins)
