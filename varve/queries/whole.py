"""Whole-table tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import longform as L
from .common import E, rounded, source


def _table(spark, sf_dir) -> DataFrame:
    return L.from_lanes(source(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding").cast("array<double>"))


def _items(spark, sf_dir) -> DataFrame:
    rows = source(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return L.from_columns(rows, key, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _out(t: DataFrame, digits: int = 4) -> DataFrame:
    return t.select(*[F.col(c).cast("long").alias(c) for c in L.axes(t)], rounded(F.col("v"), digits).alias("v"))


_LABELS = "(SELECT label, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) l"
_I = "(SELECT l_orderkey * 8 + l_linenumber AS r, CAST(unnest(range(4)) AS BIGINT) AS c, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) t"


def centroids(spark, sf_dir) -> DataFrame:
    """[label, 64]: the mean of each label's embeddings."""
    t = source(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i1", "v"))
    return t.groupBy("label", "i1").agg(F.avg("v").alias("v")).select(F.col("label").alias("i0"), "i1", "v")


def _gram_of_centroids(spark, sf_dir):
    c = centroids(spark, sf_dir)
    return _out(L.matmul(c, L.permuted(c, [1, 0])))


def _centered(spark, sf_dir):
    t = _table(spark, sf_dir)
    m = L.reduced(t, 0, "mean").select(F.col("i0").alias("i1"), "v")
    return _out(L.broadcasted(t, m, lambda a, b: a - b, ["i1"]), 6)


QUERIES = {
    "whole_sum": lambda s, d: _out(L.reduced(_items(s, d), 0, "sum"), 2),
    "whole_mean": lambda s, d: _out(L.reduced(_table(s, d), 0, "mean")),
    "whole_std": lambda s, d: _out(L.reduced(_table(s, d), 0, "std")),
    "whole_minmax": lambda s, d: _out(L.concatenated([(L.reduced(_items(s, d), 0, "min"), 4), (L.reduced(_items(s, d), 0, "max"), 4)], 0)),
    "whole_norm": lambda s, d: _out(L.reduced(_table(s, d), None, "norm"), 3),
    "whole_argmax": lambda s, d: _out(L.argmax(_table(s, d), 1)),
    "whole_cumsum": lambda s, d: _out(L.cumsum(_table(s, d), 1)),
    "whole_softmax": lambda s, d: _out(L.softmax(_table(s, d), 1), 6),
    "whole_transpose": lambda s, d: _out(L.permuted(_table(s, d), [1, 0]), 6),
    "whole_roll": lambda s, d: _out(L.rolled(_table(s, d), 5, 1, 64), 6),
    "whole_slice": lambda s, d: _out(L.sliced(_table(s, d), 1, 3, 40, 5), 6),
    "whole_matmul": _gram_of_centroids,
    "whole_gram": lambda s, d: _out(L.gram(source(s, d, "embeddings"), F.col("embedding"), 64), 4),
    "whole_outer": lambda s, d: _out(L.outer(L.reduced(_table(s, d), 1, "sum").select("i0", "v"), L.reduced(_table(s, d), 0, "mean")), 5),
    "whole_trace": lambda s, d: _out(L.trace(L.gram(source(s, d, "embeddings"), F.col("embedding"), 64)), 4),
    "whole_broadcast": _centered,
    "whole_relu": lambda s, d: _out(L.mapped(_table(s, d), lambda v: F.greatest(v, F.lit(0.0))), 6),
    "whole_histogram": lambda s, d: _out(L.histogram(_table(s, d), 32, -0.5, 0.5)),
}
_AGG = "SELECT CAST({i} AS BIGINT) AS i0, round({f}, {n}) + 0 AS v FROM {t} GROUP BY {i}"
_C = f"(SELECT label, i, avg(x) AS x FROM {_LABELS} GROUP BY label, i)"
SQL = {
    "whole_sum": _AGG.format(i="c", f="sum(v)", n=2, t=_I),
    "whole_mean": _AGG.format(i="i", f="avg(x)", n=4, t=E),
    "whole_std": _AGG.format(i="i", f="stddev_samp(x)", n=4, t=E),
    "whole_minmax": f"SELECT c AS i0, round(min(v), 4) + 0 AS v FROM {_I} GROUP BY c UNION ALL SELECT c + 4, round(max(v), 4) + 0 FROM {_I} GROUP BY c",
    "whole_norm": f"SELECT round(sqrt(sum(x * x)), 3) + 0 AS v FROM {E}",
    "whole_argmax": f"SELECT vec_id AS i0, CAST(arg_max(i, x) AS DOUBLE) AS v FROM {E} GROUP BY vec_id",
    "whole_cumsum": f"SELECT vec_id AS i0, CAST(i AS BIGINT) AS i1, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i), 4) + 0 AS v FROM {E}",
    "whole_softmax": f"SELECT vec_id AS i0, CAST(i AS BIGINT) AS i1, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) + 0 AS v FROM {E}",
    "whole_transpose": f"SELECT CAST(i AS BIGINT) AS i0, vec_id AS i1, round(x, 6) + 0 AS v FROM {E}",
    "whole_roll": f"SELECT vec_id AS i0, CAST((i + 5) % 64 AS BIGINT) AS i1, round(x, 6) + 0 AS v FROM {E}",
    "whole_slice": f"SELECT vec_id AS i0, CAST((i - 3) // 5 AS BIGINT) AS i1, round(x, 6) + 0 AS v FROM {E} WHERE i >= 3 AND i < 40 AND (i - 3) % 5 = 0",
    "whole_matmul": f"SELECT CAST(a.label AS BIGINT) AS i0, CAST(b.label AS BIGINT) AS i1, round(sum(a.x * b.x), 4) + 0 AS v FROM {_C} a JOIN {_C} b ON a.i = b.i GROUP BY a.label, b.label",
    "whole_gram": f"SELECT CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, round(sum(a.x * b.x), 4) + 0 AS v FROM {E[:-1]}a JOIN {E[:-1]}b ON a.vec_id = b.vec_id GROUP BY a.i, b.i",
    "whole_outer": f"SELECT a.vec_id AS i0, CAST(b.i AS BIGINT) AS i1, round(a.x * b.x, 5) + 0 AS v FROM (SELECT vec_id, sum(x) AS x FROM {E} GROUP BY vec_id) a, (SELECT i, avg(x) AS x FROM {E} GROUP BY i) b",
    "whole_trace": f"SELECT round(sum(x * x), 4) + 0 AS v FROM {E}",
    "whole_broadcast": f"SELECT vec_id AS i0, CAST(i AS BIGINT) AS i1, round(x - avg(x) OVER (PARTITION BY i), 6) + 0 AS v FROM {E}",
    "whole_relu": f"SELECT vec_id AS i0, CAST(i AS BIGINT) AS i1, round(greatest(x, 0::DOUBLE), 6) + 0 AS v FROM {E}",
    "whole_histogram": f"SELECT CAST(greatest(least(floor((x + 0.5::DOUBLE) / (0.5::DOUBLE + 0.5::DOUBLE) * 32), 31), 0) AS BIGINT) AS i0, CAST(count(*) AS DOUBLE) AS v FROM {E} GROUP BY 1",
}
