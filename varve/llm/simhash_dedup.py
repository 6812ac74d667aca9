"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import partitions, text_of, written
from .components import components

#: (lowest bit, width) of the fingerprint's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, size: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of the space-joined word shingles of a UTF-8 text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()  # bytes.split: 0x20 and 0x09-0x0D
    if len(words) < size:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    return list(map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(seed)))


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint: bits set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, size, seed)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        h = np.array(hashes[i : i + _CHUNK], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Whole texts; null is
    empty. ``hashed`` adds text_hash, the text's xxhash64."""
    more = ["text_hash"] * hashed
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", *more, "fp")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, size, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps.view(np.int64))], schema=schema)

    hashes = [F.xxhash64(text_of(docs)).alias(c) for c in more]
    return docs.select("doc_id", text_of(docs).cast("binary").alias("text"), *hashes).mapInArrow(run, from_arrow_schema(schema))


def _pairs(start: np.ndarray, of: np.ndarray, count: np.ndarray, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (of[i], start[i] .. start[i]+count[i]-1) in blocks of about ``step``."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
        c = count[lo:hi]
        b = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[lo:hi], c)
        yield np.repeat(of[lo:hi], c), b
        lo = hi


def _forest(fps: np.ndarray, n_index: int, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what one large bucket's links join: the first ``n_index``
    rows are table entries, the rest probes. Breadth-first search visits each
    entry once, so the links are fewer than the rows times the parts they meet."""
    index, a, b = fps[:n_index], [], []
    part = np.full(n_index, -1)
    left = np.arange(n_index)
    n = 0
    while len(left):
        frontier = [left[0]]
        part[left[0]] = n
        left = left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(index[left] ^ index[at]) <= radius
            if near.any():
                hit = left[near]
                part[hit] = n
                a.append(index[hit])
                b.append(np.full(len(hit), index[at]))
                left = left[~near]
                frontier.extend(hit.tolist())
        n += 1
    for lo in range(n_index, len(fps), 256):
        probe = fps[lo : lo + 256]
        p, i = np.nonzero(np.bitwise_count(probe[:, None] ^ index[None, :]) <= radius)
        if len(p):
            _, first = np.unique(p * n + part[i], return_index=True)
            a.append(probe[p[first]])
            b.append(index[i[first]])
    return a, b


def bucket_links(keys: np.ndarray, kinds: np.ndarray, fps: np.ndarray, radius: int, large: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) within buckets; rows are sorted by (key, kind),
    kind 0 a table entry and 1 a probe. Buckets of up to ``large`` entries yield
    every link; larger ones enough links to connect the same rows."""
    if not len(keys):
        return fps[:0], fps[:0]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    entries = np.add.reduceat(kinds == 0, start)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for r in np.flatnonzero(entries > large):
        x, y = _forest(fps[start[r] : start[r] + size[r]], int(entries[r]), radius)
        a += x
        b += y
    use = (entries > 0) & (entries <= large) & (size > 1)
    if use.any():
        n, s, e = size[use], start[use], entries[use]
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        count = np.minimum(rows, np.repeat(e, n))
        for i, j in _pairs(np.repeat(s, n), rows + np.repeat(s, n), count):
            near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            a.append(fps[i[near]])
            b.append(fps[j[near]])
    a_, b_ = (np.concatenate(x) if x else fps[:0] for x in (a, b))
    return a_[a_ != b_], b_[a_ != b_]


def spread(probes: DataFrame, most: int) -> DataFrame:
    """Deals the rows of buckets with over ``most`` table entries to pairs of
    chunks: entries of two chunks meet under one new key, probes meet each
    chunk. Keys are hashes; a collision only adds pairs, which are verified."""
    hot = probes.where("kind = 0").groupBy("key").agg(F.ceil(F.count("*") / most).alias("k")).where("k > 1")
    hot = written(hot, "hot")
    if not hot.limit(1).count():
        return probes
    dealt = probes.join(hot, "key", "left").withColumn("slot", F.pmod(F.xxhash64("fp"), "k"))
    each = F.explode_outer(F.when(F.col("k").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("key", "kind", "fp", "k", "slot", each.alias("d"))
    met = F.when(F.col("kind") == 0, F.xxhash64("key", F.least("slot", "d"), F.greatest("slot", "d"))).otherwise(F.xxhash64("key", "d", "d"))
    return dealt.select(F.when(F.col("k").isNull(), F.col("key")).otherwise(met).alias("key"), "kind", "fp")


def links(distinct: DataFrame, radius: int = 4, most: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in at most
    ``radius`` bits; they connect all that the full set of links connects.

    Of at most ``radius`` < 6 differing bits, some segment holds at most one: every fingerprint enters three tables by its exact
    segments and probes each with the segment's Hamming ball of radius 1. Full
    distances are verified inside the bucket. Probes and entries stream past in
    the order of their key. Buckets of over ``most`` entries are split, so that
    a task holds at most two times as many at once.
    """
    if radius // len(SEGMENTS) > 1:
        raise ValueError("the balls have radius 1: radius must be at most 5")

    keys = []
    for k, (lo, width) in enumerate(SEGMENTS):
        base = f"cast({k << 22} | (shiftrightunsigned(fp, {lo}) & {(1 << width) - 1}) as int)"
        keys.append(f"array(struct({base} as key, 0 as kind))")
        keys.append(f"transform(sequence(0, {width - 1}), j -> struct({base} ^ shiftleft(1, j) as key, 1 as kind))")
    probes = distinct.selectExpr("fp", f"explode_outer(concat({', '.join(keys)})) as x").selectExpr("cast(x.key as bigint) as key", "cast(x.kind as tinyint) as kind", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = bucket_links(*cols, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        last = None
        for batch in batches:
            cols = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if not len(cols[0]):
                continue
            if last is not None and cols[0][0] == last and cols[0][-1] == last:
                held.append(cols)
                continue
            # whole buckets go; the last key's rows wait for the next batch
            at = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            held.append(tuple(c[:at] for c in cols))
            yield out(tuple(np.concatenate(c) for c in zip(*held)))
            held = [tuple(c[at:] for c in cols)]
            last = cols[0][-1]
        if held:
            yield out(tuple(np.concatenate(c) for c in zip(*held)))

    n = partitions(distinct.sparkSession)
    return spread(probes, most).repartition(n, "key").sortWithinPartitions("key", "kind").mapInArrow(run, from_arrow_schema(schema))


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    docs: doc_id, text (null: empty); other columns are ignored. Texts without
    words have fingerprint zero and link like any other. component_id is the
    smallest doc_id that links reach, the row's own included. Repeated rows stay
    and share a component; a null doc_id is kept and never names a component
    unless all its members are null. An empty table gives an empty result.
    """
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _placed(fingerprints(docs, size, seed), radius).select("doc_id", hex_, "component_id")


def _placed(rows: DataFrame, radius: int) -> DataFrame:
    """Adds component_id to the rows of ``fingerprints``."""
    fps = written(rows, "fps")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp")
    roots = written(components(links(distinct, radius)), "roots")
    ids = (roots.join(distinct, roots["node"] == distinct["fp"])
           .groupBy("root").agg(F.min("rep").alias("component_id"))
           .join(roots, "root").select(F.col("node").alias("fp"), "component_id"))
    # fingerprints without links stand for themselves
    of = distinct.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    of = written(of, "components")  # so that the next join can split a fingerprint that very many rows share
    return fps.join(of, "fp").select(*fps.columns, "component_id")


def keep_one(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs without near copies: of each component the one with the
    smallest doc_id stays, of rows repeated under that id every one with a
    distinct text; rows with a null doc_id stay. Texts that share a doc_id stay
    or go each by its own component."""
    placed = _placed(fingerprints(docs, size, seed, hashed=True), radius)
    mark = max((c for c in docs.columns), key=len, default="") + "_"  # names that no column of docs has
    gone = placed.where("component_id <> doc_id").select(F.col("doc_id").alias(f"{mark}id"), F.col("text_hash").alias(f"{mark}hash")).distinct()
    same = (F.col("doc_id") == F.col(f"{mark}id")) & (F.col(f"{mark}text") == F.col(f"{mark}hash"))
    return docs.withColumn(f"{mark}text", F.xxhash64(text_of(docs))).join(gone, same, "left_anti").select(*docs.columns)
