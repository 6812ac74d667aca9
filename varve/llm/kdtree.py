"""Exact top-k by inner product over KD-trees, one per shard of the vectors."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import written

FOUND = "query_id long, vec_id long, score string"
#: Values whose products fit a long for any usual dimension; others are Python integers.
EXACT = 1 << 62


def integers(rows: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of every double: int64 where all fit, else Python integers."""
    if not rows.size or np.abs(rows).max() < 2.0**50:
        return np.floor(rows * scale).astype(np.int64)
    whole = lambda x: int(np.floor(x * scale)) if abs(x) < 2.0**50 else int(x) * scale
    return np.array([[whole(x) for x in r] for r in rows.tolist()], dtype=object).reshape(rows.shape)


def _size(a: np.ndarray) -> int:
    return int(max(abs(int(a.max())), abs(int(a.min())))) if a.size else 0


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in exact integers: as long if no sum can overflow it."""
    if _size(a) * _size(b) * max(1, a.shape[-1]) >= EXACT:
        a, b = a.astype(object), b.astype(object)
    return a @ b


class KDTree:
    """Median splits on the widest axis, a tight bounding box for every node."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 128):
        order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lows, highs = [], []

        def build(lo: int, hi: int) -> int:
            part = points[order[lo:hi]]
            low, high = part.min(axis=0), part.max(axis=0)
            node = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append(None)
            lows.append(low)
            highs.append(high)
            if hi - lo > leaf and part.shape[1]:
                mid = (lo + hi) // 2
                axis = int(np.argmax(high - low))
                order[lo:hi] = order[lo:hi][np.argsort(part[:, axis], kind="stable")]
                self.children[node] = (build(lo, mid), build(mid, hi))
            return node

        build(0, len(ids))
        self.low, self.high = np.array(lows), np.array(highs)
        self.ids, self.points = ids[order], points[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no point in the node's box scores higher."""
        return dot(np.maximum(queries, 0), self.high.T) + dot(np.minimum(queries, 0), self.low.T)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, kth: int | None) -> list[tuple[int, int]]:
        """(score, vec_id) of the best k rows other than ``own`` that score at
        least ``kth`` (None: any): nodes leave the queue by their bound, highest
        first."""
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id): the worst is on top
        queue = [(-int(bounds[0]), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if kth is not None and -bound < kth:  # equal bounds may still hold a smaller vec_id
                break
            if self.children[node]:
                for child in self.children[node]:
                    if kth is None or bounds[child] >= kth:
                        heapq.heappush(queue, (-int(bounds[child]), child))
                continue
            lo, hi = self.spans[node]
            scores = dot(self.points[lo:hi], query)
            for i in range(hi - lo) if kth is None else np.flatnonzero(scores >= kth):
                vec = int(self.ids[lo + i])
                if vec == own:
                    continue
                item = (int(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = best[0][0] if kth is None else max(kth, best[0][0])
        return [(s, -v) for s, v in best]


class Splits:
    """Median splits of a sample: which region of space a vector lies in."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.axis: list[int] = []
        self.at: list[float] = []
        self.next: list[tuple[int, int]] = []
        self.regions = 0
        self.root = self._split(sample, regions)

    def _split(self, part: np.ndarray, regions: int) -> int:
        """A split's number, or -1 - r for region r."""
        spread = part.max(axis=0) - part.min(axis=0) if part.size else np.zeros(0)
        if regions < 2 or not spread.any():
            self.regions += 1
            return -self.regions
        axis = int(np.argmax(spread))
        at = float(np.median(part[:, axis]))
        low = part[:, axis] < at
        if not low.any():  # the median is the least value
            low = part[:, axis] <= at
            at = float(np.nextafter(at, np.inf))
        node = len(self.axis)
        self.axis.append(axis)
        self.at.append(at)
        self.next.append((0, 0))
        self.next[node] = (self._split(part[low], regions // 2), self._split(part[~low], regions - regions // 2))
        return node

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.root)
        axis, at, next_ = np.array(self.axis + [0]), np.array(self.at + [0.0]), np.array(self.next + [(0, 0)])
        while (inner := np.flatnonzero(out >= 0)).size:
            n = out[inner]
            out[inner] = next_[n, (rows[inner, axis[n]] >= at[n]).astype(int)]
        return -1 - out


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): rows whose vec_id or vector is null, or that hold null
    or non-finite components, go."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"), F.size(x).alias("dim"))


def _stacked(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=np.float64) for r in rows])


def _lists(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def sortable(n: int) -> str:
    """A text that sorts as the integer does."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def number(text: str) -> int:
    """The integer of a ``sortable`` text."""
    return int(text[5:]) if text[0] == "1" else -int(text[5:].translate(str.maketrans("0123456789", "9876543210")))


def fitted_splits(data: DataFrame, n: int, shard_rows: int, sample: int = 32_768, most_regions: int = 2048) -> dict[int, Splits]:
    """Splits for the most frequent dimension, from at most ``sample`` rows in
    the order of their hashes; no more than ``most_regions`` regions, so that
    their boxes stay small however large the table is."""
    share = min(1.0, 4 * sample / max(n, 1))
    draw = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    drawn = data.where(draw <= F.lit(int((1 << 30) * share)))
    top = drawn.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not top or top[0]["dim"] < 1:
        return {}
    dim = top[0]["dim"]
    rows = drawn.where(F.col("dim") == dim).select("v", draw.alias("draw")).orderBy("draw").limit(sample).select("v").toArrow()
    regions = max(1, min(most_regions, -(-n // shard_rows), rows.num_rows // 4))
    return {dim: Splits(_lists(rows.column(0).combine_chunks(), dim), regions)}


def topk(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, shard_rows: int = 4096, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query.

    vectors: vec_id, embedding (array of numbers); other columns are ignored.
    Queries are the rows whose vec_id is divisible by ``query_every``; the
    candidates are all rows but those with the query's own vec_id. Score is the
    integer inner product of floor(scale * x) over the components x; ties go to
    the smaller vec_id. Vectors of another length than the query's are no
    candidates. A repeated row is a candidate as often as it occurs, and as a
    query it is answered once. Scores are exact whatever their size, and so are
    the ranks; one that no long can hold is given as the nearest long. Empty
    tables give no rows.

    Median splits of a bounded sample deal the rows to regions; a region of many
    rows is dealt on to shards by a hash, and each shard's tree is built once
    and written. A first pass asks one shard of the region with the highest
    bound for each query; the k-th score found there drops all regions whose box
    can't reach it, before the second pass asks the shards of the others.
    """
    data = written(sound(vectors), "vectors")
    n = data.count()
    shared = data.sparkSession.sparkContext.broadcast(fitted_splits(data, n, shard_rows))
    region = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("region", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = shared.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            out = np.zeros(len(dims), np.int32)
            for d, s in splits.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    out[at] = s.of(_lists(batch.column(1).take(pa.array(at)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema=region)

    placed = written(data.mapInArrow(place, from_arrow_schema(region)), "placed")
    sizes = placed.groupBy("dim", "region").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sizes = written(sizes, "regions")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = integers(_stacked(rows["v"]), scale) if key[0] else np.zeros((len(rows), 0), np.int64)
        tree = KDTree(rows["vec_id"].to_numpy(), points)
        box = pickle.dumps((tree.low[0], tree.high[0]))
        return pd.DataFrame([(*key, box, pickle.dumps(tree, protocol=5))], columns=["dim", "region", "shard", "box", "tree"])

    shards = placed.join(sizes.select("dim", "region", "shards"), ["dim", "region"])
    # rows repeated under an id are dealt by their place in the table
    shards = shards.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("shards")).cast("int"))
    trees = written(shards.groupBy("dim", "region", "shard").applyInPandas(build, "dim int, region int, shard int, box binary, tree binary"), "trees")

    def united(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        boxes = [pickle.loads(b) for b in rows["box"]]
        box = np.min([b[0] for b in boxes], axis=0), np.max([b[1] for b in boxes], axis=0)
        return pd.DataFrame([(*key, pickle.dumps(box))], columns=["dim", "region", "box"])

    frequent = [int(d) for d in shared.value]
    boxes = trees.where(F.col("dim").isin(frequent)).select("dim", "region", "box").groupBy("dim", "region").applyInPandas(united, "dim int, region int, box binary")
    found = [(r["dim"], r["region"], *pickle.loads(r["box"])) for r in boxes.collect()]  # at most most_regions rows
    known = {d: ([r for x, r, *_ in found if x == d], np.array([lo for x, _, lo, _ in found if x == d]), np.array([hi for x, *_, hi in found if x == d])) for d in frequent if any(x == d for x, *_ in found)}
    bounds = data.sparkSession.sparkContext.broadcast(known)

    q = placed.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x"))
    q = written(q.select(F.col("vec_id").alias("query_id"), "x.dim", F.col("x.v").alias("q")), "queries")

    asked = pa.schema([("query_id", pa.int64()), ("dim", pa.int32()), ("q", pa.list_(pa.float64())), ("kth", pa.string()), ("region", pa.int32())])

    def regions_for(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes = bounds.value
            for batch in batches:
                rows, regions = [], []
                dims, kths = batch.column(1).to_numpy(), batch.column(3).to_pylist()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    if d not in boxes:
                        rows += at.tolist()
                        regions += [0] * len(at)
                        continue
                    names, low, high = boxes[d]
                    qs = integers(_lists(batch.column(2).take(pa.array(at)), d), scale)
                    reach = dot(np.maximum(qs, 0), high.T) + dot(np.minimum(qs, 0), low.T)
                    for i, b in zip(at.tolist(), reach):
                        kth = None if kths[i] is None else number(kths[i])
                        use = [int(np.argmax(b))] if first else range(len(names)) if kth is None else np.flatnonzero(b >= kth).tolist()
                        rows += [i] * len(use)
                        regions += [names[x] for x in use]
                for lo in range(0, len(rows), 4096):
                    part = batch.take(pa.array(rows[lo : lo + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(regions[lo : lo + 4096], pa.int32())], schema=asked)

        return run

    def ask(key: tuple, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(trees):
            tree = pickle.loads(trees["tree"].iloc[0])
            qs = integers(_stacked(queries["q"]), scale) if key[0] else np.zeros((len(queries), 0), np.int64)
            for lo in range(0, len(qs), 256):
                reach = tree.bounds(qs[lo : lo + 256])
                for i, a, b, kth in zip(queries["query_id"].tolist()[lo : lo + 256], qs[lo : lo + 256], reach, queries["kth"].tolist()[lo : lo + 256]):
                    out += [(i, v, sortable(s)) for s, v in tree.search(a, i, b, k, number(kth) if isinstance(kth, str) else None)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "object"})

    def met(queries: DataFrame) -> DataFrame:
        """Blocks of a shard's queries meet its tree."""
        by = ["dim", "region", "shard", "block"]
        count = queries.groupBy("dim", "region", "shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        count = written(count, "asked")
        left = queries.join(count, by[:3]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        right = trees.drop("box").join(count, by[:3]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return left.select("query_id", "q", "kth", *by).groupBy(*by).cogroup(right.select("tree", *by).groupBy(*by)).applyInPandas(ask, FOUND)

    shards_of = sizes.select("dim", "region", "shards")
    one = q.withColumn("kth", F.lit(None).cast("string")).mapInArrow(regions_for(True), from_arrow_schema(asked)).join(shards_of, ["dim", "region"])
    home = one.withColumn("shard", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("shards")).cast("int")).drop("shards")
    first = written(met(home), "first")
    # k rows in the home shard: the k-th score bounds all others
    bound = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "kth")
    second = q.join(bound, "query_id", "left").select("query_id", "dim", "q", "kth").mapInArrow(regions_for(False), from_arrow_schema(asked)).join(shards_of, ["dim", "region"])
    second = second.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = met(written(second, "second")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", _long("score").alias("score"))


def _long(text: str):
    """A ``sortable`` text as long, saturated."""
    digits = F.substring(text, 6, 1 << 20)
    value = F.when(F.col(text).startswith("1"), digits).otherwise(F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210")))
    limit = F.when(F.col(text).startswith("1"), F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return F.coalesce(value.try_cast("long"), limit)
