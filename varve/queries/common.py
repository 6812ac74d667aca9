"""What the queries share: sources, imports, flat results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Pipeline

IMPORTS = "".join(f"import {p}/latest\n" for p in ("base", "math_basics", "tensor_basics", "tensor_stats", "nn_basics", "linalg_basics", "audio_basics", "image_basics"))
TWINS = "plugin openblas/0.1.0\nplugin opencv-bridge/0.1.0\nimport tensor_blas/latest\nimport linalg_blas/latest\nimport image_opencv/latest\n"
#: The elements of all embeddings in double precision, as SQL.
E = "(SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e"
#: Small whole numbers from the embeddings: arithmetic on them is exact in single precision.
N = "(SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 16) AS BIGINT) AS n FROM embeddings) e"

#: The elements as multiples of 1/256: sums and halves are exact in single precision.
Q = E.replace("CAST(unnest(embedding) AS DOUBLE)", "floor(CAST(unnest(embedding) AS DOUBLE) * 256) / 256")


def source(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(spark, sf_dir: str, dtype: str = "double") -> DataFrame:
    """vec_id and x, the embedding as an array of doubles or floats."""
    return source(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast(f"array<{dtype}>").alias("x"))


def whole_lanes(spark, sf_dir: str, dtype: str = "float") -> DataFrame:
    """vec_id and x, floor(16 * component)."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 16).cast(dtype))
    return source(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))


def exact_lanes(spark, sf_dir: str) -> DataFrame:
    """vec_id and x, components as floats that are multiples of 1/256."""
    x = F.transform("embedding", lambda e: (F.floor(e.cast("double") * 256) / 256).cast("float"))
    return source(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))


def text(steps: str, accept: str = "accept Tensor[64] $x", twins: bool = False) -> str:
    return f"{TWINS if twins else IMPORTS}{accept}\n{steps}\n"


def rounded(c: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def flat(df: DataFrame, digits: int = 6, column: str = "output") -> DataFrame:
    """vec_id, i, v: the elements of a tensor column in their order."""
    out = df.select("vec_id", F.posexplode(F.col(column)["data"]).alias("i", "e"))
    return out.select("vec_id", "i", rounded(F.col("e"), digits).alias("v"))


def run(spark, sf_dir: str, steps: str, *, dtype: str = "double", whole: bool = False, exact: bool = False, accept: str = "accept Tensor[64] $x", engine: str = "auto", twins: bool = False) -> DataFrame:
    df = exact_lanes(spark, sf_dir) if exact else whole_lanes(spark, sf_dir, dtype) if whole else lanes(spark, sf_dir, dtype)
    return Pipeline(text(steps, accept, twins)).run(df, keep=["vec_id"], engine=engine)


def tensor_query(steps: str, digits: int = 6, **options):
    """A query whose one emit is a tensor: its elements as rows."""
    return lambda spark, sf_dir: flat(run(spark, sf_dir, steps, **options), digits)


def scalar_query(steps: str, digits: int = 6, **options):
    """A query whose one emit is a scalar."""
    return lambda spark, sf_dir: run(spark, sf_dir, steps, **options).select("vec_id", rounded(F.col("output"), digits).alias("v"))
