"""Readers and writers of payload tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Pipeline, cell_type, column
from ..types import Value


def read_bytes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, bytes: files as byte payloads; names filter at the listing."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("content").alias("bytes"))


def read_wav(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, audio: wave files decoded to planar single precision."""
    pipeline = Pipeline("import audio_basics/latest\naccept Bytes $bytes\n$bytes >> to_audio >> emit(\"audio\")\n")
    return pipeline.run(read_bytes(spark, path, pattern), keep=["path"])


def to_wav(df: DataFrame, audio: str, dtype: str = "i16", name: str = "wav") -> DataFrame:
    """Adds wave files as a binary column made from an audio column."""
    pipeline = Pipeline(f"import audio_basics/latest\naccept Audio $a\n$a >> to_wav(\"{dtype}\") >> emit(\"{name}\")\n")
    return pipeline.run(df, keep=df.columns, a=F.col(audio))


def tensor_column(data, shape: Sequence[int]):
    """An array column as tensor cells of a fixed shape."""
    return F.struct(F.array(*[F.lit(int(n)).cast("long") for n in shape]).alias("shape"), data.alias("data"))


def columns_as_tensor(df: DataFrame, columns: Sequence[str], name: str = "tensor", dtype: str = "double") -> DataFrame:
    """Adds a rank-1 tensor of numeric columns."""
    return df.withColumn(name, F.array(*[F.col(c).cast(dtype) for c in columns]))


def lanes_by_key(df: DataFrame, key: str, order: Sequence[str], value: str, name: str = "lane", longest: int = 1 << 20) -> DataFrame:
    """key, lane: each key's values in order as arrays. A key with more than
    ``longest`` values is cut into several lanes (column ``part``), so that no
    cell or task grows with one key: values are numbered by sorted ranges."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    part = df.withColumn("__n", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("__n") / longest).cast("long"))
    lanes = part.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("__n", F.col(value).alias("v")))).alias("c"))
    return lanes.select(key, "part", F.transform("c", lambda x: x["v"]).alias(name))


def payloads(spark: SparkSession, values: Sequence[Value], name: str = "payload", rows: int = 256) -> DataFrame:
    """id, payload: host values of one kind and dtype as a DataFrame."""
    import pyarrow as pa

    first = values[0]
    t = (first.kind, None if first.kind in ("bytes", "arg") else np.dtype(first.dtype))
    table = pa.table({"id": pa.array(range(len(values)), pa.int64()), name: column(list(values), t)})
    df = spark.createDataFrame(table)
    assert df.schema[name].dataType.simpleString() == cell_type(t).simpleString()
    return df
