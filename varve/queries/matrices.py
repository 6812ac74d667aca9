"""Linear algebra. Inputs are small whole numbers, so that products and sums are
exact in single precision; factors are checked by what they multiply to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Pipeline
from .common import E, N, flat, rounded, scalar_query, tensor_query, text, whole_lanes

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SQUARE = f"SELECT a.vec_id, CAST((a.i // 8) * 8 + b.i % 8 AS INTEGER) AS i, round(CAST(sum(a.n * b.n) AS DOUBLE), 3) + 0 AS v FROM {N[:-1]}a JOIN {N[:-1]}b ON a.vec_id = b.vec_id AND a.i % 8 = b.i // 8 GROUP BY a.vec_id, (a.i // 8) * 8 + b.i % 8"
_OUTER = f"SELECT a.vec_id, CAST(a.i * 64 + b.i AS INTEGER) AS i, round(CAST(a.n * b.n AS DOUBLE), 3) + 0 AS v FROM {N[:-1]}a JOIN {N[:-1]}b ON a.vec_id = b.vec_id"
_DOT = f"SELECT vec_id, 0 AS i, round(CAST(sum(n * n) AS DOUBLE), 3) + 0 AS v FROM {N} GROUP BY vec_id"

for _prefix, _twins in (("linalg", False), ("blas", True)):
    QUERIES[f"{_prefix}_matmul"] = (lambda spark, sf_dir: _twin(spark, sf_dir, "matmul", 3)) if _twins else tensor_query('$x >> reshape("8,8") >> matmul >> emit', 3, whole=True)
    SQL[f"{_prefix}_matmul"] = _SQUARE
    QUERIES[f"{_prefix}_dot"] = tensor_query("$x >> dot >> emit", 3, whole=True, twins=_twins)
    SQL[f"{_prefix}_dot"] = _DOT
    QUERIES[f"{_prefix}_outer"] = tensor_query("$x >> outer >> emit", 3, whole=True, twins=_twins)
    SQL[f"{_prefix}_outer"] = _OUTER


def _twin(spark, sf_dir, action, digits):
    program = "plugin openblas/0.1.0\nimport linalg_blas/latest\nimport tensor_basics/latest\naccept Tensor[64] $x\n" + f'$x >> reshape("8,8") >> {action} >> emit\n'
    return flat(Pipeline(program).run(whole_lanes(spark, sf_dir), keep=["vec_id"]), digits)


QUERIES["linalg_trace"] = scalar_query('$x >> reshape("8,8") >> trace >> emit', 3, whole=True)
SQL["linalg_trace"] = f"SELECT vec_id, round(CAST(sum(n) AS DOUBLE), 3) + 0 AS v FROM {N} WHERE i % 9 = 0 GROUP BY vec_id"
QUERIES["linalg_diag"] = tensor_query('$x >> reshape("8,8") >> diag(1) >> emit', 3, whole=True)
SQL["linalg_diag"] = f"SELECT vec_id, CAST(i // 8 AS INTEGER) AS i, CAST(n AS DOUBLE) + 0 AS v FROM {N} WHERE i % 8 = i // 8 + 1"

# [8, 8] matrices of all 64 components, 40 added on the diagonal; results are in single precision
_CELLS = f"(SELECT vec_id, list(CAST(n + CASE WHEN i % 9 = 0 THEN 40 ELSE 0 END AS DOUBLE) ORDER BY i) AS m FROM {N} GROUP BY vec_id)"


def _eliminated(cells: str, width: int, steps: int, below: bool) -> str:
    """Elimination column by column on rows of ``width``, as nested selects."""
    for k in range(steps):
        rows = f"t // {width} > {k}" if below else f"t // {width} <> {k}"
        cells = f"(SELECT vec_id, list_transform(range({8 * width}), lambda t: CASE WHEN {rows} THEN m[t + 1] - (m[(t // {width}) * {width} + {k + 1}] / m[{k * width + k + 1}]) * m[{k * width} + t % {width} + 1] ELSE m[t + 1] END) AS m FROM {cells})"
    return cells


_SINGLE = f"(SELECT vec_id, CAST(m AS FLOAT[]) AS m FROM {_CELLS})"  # as the determinant's elimination works
_BESIDE_UNIT = f"(SELECT vec_id, list_transform(range(128), lambda t: CASE WHEN t % 16 < 8 THEN m[(t // 16) * 8 + t % 16 + 1] WHEN t % 16 - 8 = t // 16 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS m FROM {_CELLS})"
_ELEMENT = "SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, round(CAST(unnest(list_transform(range(64), lambda t: {f})) AS DOUBLE), {n}) + 0 AS v FROM {t}"


def _matrix(spark, sf_dir, action, pack, reverse=True):
    """The action over whole [8, 8] matrices. Reversed rows put small numbers on
    the diagonal, so that a solver has to pivot."""
    plug = "plugin openblas/0.1.0\n" if pack == "linalg_blas" else ""
    program = f"{plug}import {pack}/latest\naccept Tensor[8,8] $x\n$x >> {action} >> emit\n"
    at = lambda t: (7 - F.floor(t / 8)) * 8 + t % 8 if reverse else t
    cell = lambda t: F.get("x", at(t).cast("int")) + F.when(at(t) % 9 == 0, 40.0).otherwise(0.0)
    data = F.transform(F.sequence(F.lit(0), F.lit(63)), cell)
    shape = F.array(F.lit(8).cast("long"), F.lit(8).cast("long"))
    df = whole_lanes(spark, sf_dir, "double").select("vec_id", F.struct(shape.alias("shape"), data.alias("data")).alias("x"))
    return Pipeline(program).run(df, keep=["vec_id"])


def _products(df, data, left, right):
    """Sums over k of data[left(i, j, k)] * data[right(i, j, k)] for all i and j."""
    df = df.select("vec_id", data.alias("d"))
    cell = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, k: s + F.get("d", left(F.floor(t / 8).cast("int"), t % 8, k)).cast("double") * F.get("d", right(F.floor(t / 8).cast("int"), t % 8, k)))
    out = df.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), cell)).alias("i", "e"))
    return out.select("vec_id", "i", rounded(F.col("e"), 2).alias("v"))


for _prefix, _pack in (("linalg", "linalg_basics"), ("blas", "linalg_blas")):
    QUERIES[f"{_prefix}_det"] = (lambda pack: lambda spark, sf_dir: _matrix(spark, sf_dir, "det", pack).select("vec_id", rounded(F.col("output") / F.lit(40.0**8), 6).alias("v")))(_pack)
    SQL[f"{_prefix}_det"] = f"SELECT vec_id, round(CAST({' * '.join(f'm[{9 * t + 1}]' for t in range(8))} AS DOUBLE) / pow(40::DOUBLE, 8), 6) + 0 AS v FROM {_eliminated(_SINGLE, 8, 7, True)}"
    QUERIES[f"{_prefix}_inv"] = (lambda pack: lambda spark, sf_dir: flat(_matrix(spark, sf_dir, "inv", pack), 8))(_pack)
    SQL[f"{_prefix}_inv"] = _ELEMENT.format(f="CAST(m[(t // 8) * 16 + 8 + 7 - t % 8 + 1] / m[(t // 8) * 16 + t // 8 + 1] AS FLOAT)", n=8, t=_eliminated(_BESIDE_UNIT, 16, 8, False))
    # R'R = A'A whatever the columns' signs
    QUERIES[f"{_prefix}_qr"] = (lambda pack: lambda spark, sf_dir: _products(_matrix(spark, sf_dir, "qr", pack), F.col("output")["_1"]["data"], lambda i, j, k: k * 8 + i, lambda i, j, k: k * 8 + j))(_pack)
    SQL[f"{_prefix}_qr"] = _ELEMENT.format(f="list_sum(list_transform(range(8), lambda k: m[k * 8 + t // 8 + 1] * m[k * 8 + t % 8 + 1]))", n=2, t=_CELLS)
    # LL' is the matrix of the lower triangle
    QUERIES[f"{_prefix}_cholesky"] = (lambda pack: lambda spark, sf_dir: _products(_matrix(spark, sf_dir, "cholesky", pack, False), F.col("output")["data"], lambda i, j, k: i * 8 + k, lambda i, j, k: j * 8 + k))(_pack)
    SQL[f"{_prefix}_cholesky"] = _ELEMENT.format(f="m[greatest(t // 8, t % 8) * 8 + least(t // 8, t % 8) + 1]", n=2, t=_CELLS)


def _pairs(spark, sf_dir):
    """Each embedding with its own rolled by one, as a composite."""
    cell = lambda c: F.struct(F.array(F.lit(64).cast("long")).alias("shape"), c.alias("data"))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rolled = F.concat(F.slice("x", 2, 63), F.slice("x", 1, 1))
    return df.select("vec_id", F.struct(cell(F.col("x")).alias("_0"), cell(rolled).alias("_1")).alias("pair"))


_PAIR = f"(SELECT vec_id, i, x, coalesce(lead(x) OVER (PARTITION BY vec_id ORDER BY i), first_value(x) OVER (PARTITION BY vec_id ORDER BY i)) AS y FROM {E}) p"
for _name, _sql in (("add", "x + y"), ("sub", "x - y"), ("mul", "x * y")):
    QUERIES[f"binary_{_name}"] = (lambda a: lambda spark, sf_dir: flat(Pipeline(text(f"$pair >> {a} >> emit", "accept Composite[Tensor[64], Tensor[64]] $pair")).run(_pairs(spark, sf_dir), keep=["vec_id"])))(_name)
    SQL[f"binary_{_name}"] = f"SELECT vec_id, i, round({_sql}, 6) + 0 AS v FROM {_PAIR}"
QUERIES["nn_cosine_similarity"] = lambda spark, sf_dir: flat(Pipeline(text("$pair >> cosine_similarity >> emit", "accept Composite[Tensor[64], Tensor[64]] $pair")).run(_pairs(spark, sf_dir), keep=["vec_id"]))
SQL["nn_cosine_similarity"] = f"SELECT vec_id, 0 AS i, round(sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-8::DOUBLE), 6) + 0 AS v FROM {_PAIR} GROUP BY vec_id"
# [8, 8] with its row of column maxima: the size-1 axis broadcasts
QUERIES["binary_broadcast"] = lambda spark, sf_dir: flat(Pipeline(text("$pair >> sub >> emit", "accept Composite[Tensor[8,8], Tensor[1,8]] $pair")).run(_tops(spark, sf_dir), keep=["vec_id"]))
SQL["binary_broadcast"] = f"SELECT vec_id, i, round(x - max(x) OVER (PARTITION BY vec_id, i % 8), 6) + 0 AS v FROM {E}"


def _tops(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    shape = lambda *n: F.array(*[F.lit(k).cast("long") for k in n]).alias("shape")
    top = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.get("x", r * 8 + j))))
    return df.select("vec_id", F.struct(F.struct(shape(8, 8), F.col("x").alias("data")).alias("_0"), F.struct(shape(1, 8), top.alias("data")).alias("_1")).alias("pair"))
