"""Whole-table tensors as relations: a row for each element, its indices in
columns i0, i1, ... and its value in v. For tensors too large for a cell.

Reductions combine before they shuffle; products join on the shared index and
combine partial sums; scans and normalizations are window functions over lanes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axes(t: DataFrame) -> list[str]:
    """The index columns in their order."""
    return sorted((c for c in t.columns if c[0] == "i" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def from_lanes(df: DataFrame, row: Column, lane: Column) -> DataFrame:
    """[rows, n] of an array column."""
    return df.select(row.alias("i0"), F.posexplode(lane).alias("i1", "v"))


def from_columns(df: DataFrame, row: Column, columns: Sequence[str]) -> DataFrame:
    """[rows, columns] of numeric columns."""
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    return from_lanes(df, row, cells)


def mapped(t: DataFrame, f) -> DataFrame:
    return t.withColumn("v", f(F.col("v")))


def permuted(t: DataFrame, dims: Sequence[int]) -> DataFrame:
    names = axes(t)
    return t.select(*[F.col(names[d]).alias(f"i{k}") for k, d in enumerate(dims)], "v")


def rolled(t: DataFrame, shift: int, axis: int, size: int) -> DataFrame:
    return t.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + shift, F.lit(size)))


def sliced(t: DataFrame, axis: int, start: int, stop: int, step: int = 1) -> DataFrame:
    at = F.col(f"i{axis}")
    return t.where((at >= start) & (at < stop) & ((at - start) % step == 0)).withColumn(f"i{axis}", F.floor((at - start) / step))


def concatenated(tensors: Sequence[tuple[DataFrame, int]], axis: int) -> DataFrame:
    """Tensors with their sizes along ``axis``."""
    out, offset = None, 0
    for t, size in tensors:
        moved = t.withColumn(f"i{axis}", F.col(f"i{axis}") + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += size
    return out


def reduced(t: DataFrame, axis: int | None, how: str) -> DataFrame:
    """sum, mean, var, std, min, max or norm over an axis (None: all). The
    indices behind the axis move up."""
    v = F.col("v")
    agg = {"sum": F.sum(v), "mean": F.avg(v), "var": F.var_samp(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "norm": F.sqrt(F.sum(v * v))}[how]
    names = axes(t)
    kept = [] if axis is None else names[:axis] + names[axis + 1 :]
    return t.groupBy(*kept).agg(agg.alias("v")).select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(kept)], "v")


def argmax(t: DataFrame, axis: int, least: bool = False) -> DataFrame:
    names = axes(t)
    kept = names[:axis] + names[axis + 1 :]
    best = F.struct((-F.col("v") if not least else F.col("v")).alias("v"), F.col(names[axis]).alias("i"))
    return t.groupBy(*kept).agg(F.min(best)["i"].alias("v")).select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(kept)], "v")


def cumsum(t: DataFrame, axis: int) -> DataFrame:
    names = axes(t)
    w = Window.partitionBy(*[n for k, n in enumerate(names) if k != axis]).orderBy(names[axis]).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("v", F.sum("v").over(w))


def softmax(t: DataFrame, axis: int) -> DataFrame:
    names = axes(t)
    w = Window.partitionBy(*[n for k, n in enumerate(names) if k != axis])
    e = t.withColumn("v", F.exp(F.col("v") - F.max("v").over(w)))
    return e.withColumn("v", F.col("v") / F.sum("v").over(w))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """[m, k] x [k, n]: a join on k, sums combined before the shuffle by (m, n)."""
    left = a.select(F.col("i0").alias("m"), F.col("i1").alias("k"), F.col("v").alias("a"))
    right = b.select(F.col("i0").alias("k"), F.col("i1").alias("n"), F.col("v").alias("b"))
    out = left.join(right, "k").groupBy("m", "n").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    return out.select(F.col("m").alias("i0"), F.col("n").alias("i1"), "v")


def gram(df: DataFrame, lane: Column, size: int) -> DataFrame:
    """X'X of an array column [rows, size] in one pass: each row's products are
    summed by place, so nothing but size * size sums is shuffled."""
    x = df.select(F.slice(lane, 1, size).alias("x"))
    left = x.select("x", F.posexplode("x").alias("i0", "a"))
    each = left.select("i0", "a", F.posexplode("x").alias("i1", "b")).select("i0", "i1", (F.col("a").cast("double") * F.col("b")).alias("v"))
    return each.groupBy("i0", "i1").agg(F.sum("v").alias("v"))


def outer(a: DataFrame, b: DataFrame, block: int = 4096) -> DataFrame:
    """[m] x [n]: b in blocks of indices, each a bounded lane, and each element of
    a once for every block that it meets."""
    lanes = b.groupBy(F.floor(F.col("i0") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i0", "v"))).alias("lane"))
    last = b.agg(F.floor(F.max("i0") / block)).first()[0]
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(last if last is not None else 0).cast("long"))
    rows = a.select(F.col("i0").alias("m"), F.col("v").alias("a"), F.explode(blocks).alias("block")).join(lanes, "block")
    return rows.select("m", "a", F.explode("lane").alias("x")).select(F.col("m").alias("i0"), F.col("x.i0").alias("i1"), (F.col("a") * F.col("x.v")).alias("v"))


def trace(t: DataFrame) -> DataFrame:
    return t.where("i0 = i1").agg(F.sum("v").alias("v"))


def broadcasted(a: DataFrame, b: DataFrame, f, on: Sequence[str]) -> DataFrame:
    """f(a, b) where b spans only the axes ``on``: size-1 axes are left out of it."""
    return a.join(b.select(*on, F.col("v").alias("b")), list(on)).select(*axes(a), f(F.col("v"), F.col("b")).alias("v"))


def histogram(t: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Counts of the values by bin, clamped to the ends."""
    at = F.greatest(F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)), F.lit(0))
    return t.groupBy(at.cast("int").alias("i0")).agg(F.count("*").cast("double").alias("v"))
