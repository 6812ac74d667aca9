"""Best-fit-decreasing packing into token id matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import text_of
from .tokens import Ids

ROWS = pa.schema([("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ids", pa.binary()), ("cu_seqlens", pa.binary()), ("position_ids", pa.binary())])


class Capacities:
    """Segment tree over free space: counts of bins, and which bins."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        at = self.width + free
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._add(free, 1)

    def tightest(self, size: int) -> int | None:
        """Takes out a bin with the least free space that is at least ``size``;
        its free space is returned, the bin is last in ``taken``."""
        at = self.width + size
        if not self.count[at]:
            # up to the first right-hand neighbour that holds bins, then down its left side
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.width
        self.taken = self.bins[free].pop()
        self._add(free, -1)
        return free


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: by falling size, each goes where least room remains."""
    tree, bins = Capacities(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        free = tree.tightest(sizes[i])
        if free is None:
            bins.append([])
            free, tree.taken = capacity, len(bins) - 1
        bins[tree.taken].append(i)
        if free > sizes[i]:
            tree.put(free - sizes[i], tree.taken)
    return bins


def token_matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, eos: int = 2, pad: int = 0, buffer_tokens: int = 8_000_000) -> DataFrame:
    """Packed sequences as rows of binary columns (little-endian 32-bit):

    ids: the row of the id matrix, ``capacity`` ids, ``pad`` behind the end.
    cu_seqlens: cumulative segment lengths from 0. position_ids: positions that
    start anew with each segment, 0 in the padding. doc_ids and starts name each
    segment's document and its first token there; sequence_id is unique.

    docs: doc_id, text (null: empty); other columns are ignored. A document is
    its ids and ``eos``; those longer than the capacity are split into full
    segments and a rest, nothing is lost. Each task packs the documents of its
    partition in buffers of about ``buffer_tokens``, so no text or id is
    shuffled. Repeated rows are packed once each; a null doc_id stays null; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number = Ids(tokenizer), TaskContext.get().partitionId() << 40
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            bins = best_fit_decreasing([len(x[2]) for x in held], capacity)
            for lo in range(0, len(bins), 512):
                rows: list[tuple] = []
                for b in bins[lo : lo + 512]:
                    parts = [held[i] for i in b]
                    lengths = np.array([len(x[2]) for x in parts])
                    used = int(lengths.sum())
                    ids, position = np.full(capacity, pad, "<u4"), np.zeros(capacity, "<u4")
                    ids[:used] = np.concatenate([x[2] for x in parts])
                    ends = np.cumsum(lengths)
                    position[:used] = np.arange(used) - np.repeat(ends - lengths, lengths)
                    rows.append((number, [x[0] for x in parts], [x[1] for x in parts], ids.tobytes(), np.r_[0, ends].astype("<u4").tobytes(), position.tobytes()))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)
            held.clear()

        total = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), eos], dtype="<u4")
                held += [(doc_id, s, ids[s : s + capacity]) for s in range(0, len(ids), capacity)]
                total += len(ids)
                if total >= buffer_tokens:
                    yield from flush()
                    total = 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, from_arrow_schema(ROWS))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write ``token_matrices`` rows as Parquet."""
    packed.write.mode("errorifexists").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, starts, n_segments, n_tokens and crc32 of each binary column."""
    size = lambda c: (F.octet_length(c) / 4).cast("long")
    last = F.reverse(F.substring(F.col("cu_seqlens"), -4, 4))
    return packed.select("sequence_id", "doc_ids", "starts", (size("cu_seqlens") - 1).alias("n_segments"), F.conv(F.hex(last), 16, 10).cast("long").alias("n_tokens"), *[F.crc32(c).alias(f"{c}_crc32") for c in ("ids", "cu_seqlens", "position_ids")])
