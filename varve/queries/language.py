"""Language operators: parameters, taps, emits, indices, branches, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Pipeline
from .common import E, IMPORTS, flat, lanes, rounded, scalar_query, source, tensor_query, text

FLAGSHIP = """
import math_basics/latest
import nn_basics/latest
import tensor_stats/latest
accept Tensor[64] $embedding
$embedding >> layer_norm >> softmax >> $p
$p >> max >> emit("confidence")
$p >> argmax >> emit("best")
"""


def flagship(spark, sf_dir) -> DataFrame:
    """Normalize, softmax and pick: the confidence and place of each best component."""
    df = source(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = Pipeline(FLAGSHIP).run(df, keep=["vec_id"])
    return out.select("vec_id", rounded(F.col("confidence"), 6).alias("confidence"), F.get(F.col("best")["data"], F.lit(0)).alias("best"))


QUERIES: dict = {"flagship": flagship}
SQL: dict[str, str] = {"flagship": f"""
WITH n AS (SELECT vec_id, i, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5::DOUBLE) AS z FROM {E} WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT vec_id, i, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM n)
SELECT vec_id, round(max(p), 6) + 0 AS confidence, arg_max(i, p) AS best FROM p GROUP BY vec_id"""}

for _name, _steps, _where, _i in [
    ("slice_range", "$x[8:40:3] >> emit", "i >= 8 AND i < 40 AND (i - 8) % 3 = 0", "(i - 8) // 3"),
    ("slice_negative_step", "$x[-2::-5] >> emit", "(62 - i) % 5 = 0 AND i <= 62", "(62 - i) // 5"),
    ("slice_axes", '$x >> reshape("8,8") >> $m\n$m[1:4, ::2] >> emit', "i // 8 BETWEEN 1 AND 3 AND i % 2 = 0", "(i // 8 - 1) * 4 + (i % 8) // 2"),
    ("slice_row", '$x >> reshape("8,8") >> $m\n$m[-1] >> emit', "i // 8 = 7", "i % 8"),
    ("slice_chained", '$x >> reshape("8,8") >> $m\n$m[2][1:] >> emit', "i // 8 = 2 AND i % 8 >= 1", "i % 8 - 1"),
]:
    QUERIES[_name] = tensor_query(_steps)
    SQL[_name] = f"SELECT vec_id, CAST({_i} AS INTEGER) AS i, round(x, 6) + 0 AS v FROM {E} WHERE {_where}"
QUERIES["index_scalar"] = scalar_query("$x[-3] >> emit")
SQL["index_scalar"] = f"SELECT vec_id, round(x, 6) + 0 AS v FROM {E} WHERE i = 61"

_IF = "$x >> if ($payload.mean > 0) {{ mul(2) >> add(1) }} else {{ {other} }} >> emit"
QUERIES["branch_if"] = tensor_query(_IF.format(other="neg"))
SQL["branch_if"] = f"SELECT vec_id, i, round(CASE WHEN avg(x) OVER (PARTITION BY vec_id) > 0 THEN x * 2 + 1 ELSE -x END, 6) + 0 AS v FROM {E}"
QUERIES["branch_pass_through"] = tensor_query("$x >> if ($x[0] > 0.1) { abs } >> emit")
SQL["branch_pass_through"] = f"SELECT vec_id, i, round(CASE WHEN max(x) FILTER (i = 0) OVER (PARTITION BY vec_id) > 0.1::DOUBLE THEN abs(x) ELSE x END, 6) + 0 AS v FROM {E}"


def _route(engine: str):
    def query(spark, sf_dir):
        p = Pipeline(IMPORTS + "accept Scalar $value\n$value >> route { $value > 100 => { sub(100) >> sqrt } $value > 10 => mul(0.5) else => neg } >> emit\n")
        df = source(spark, sf_dir, "events").select("event_id", "value")
        return p.run(df, keep=["event_id"], engine=engine).select("event_id", rounded(F.col("output"), 5).alias("v"))

    return query


QUERIES["branch_route"], QUERIES["branch_route_kernels"] = _route("columns"), _route("kernels")
SQL["branch_route"] = SQL["branch_route_kernels"] = "SELECT event_id, round(CASE WHEN value > 100 THEN sqrt(value - 100) WHEN value > 10 THEN value * 0.5::DOUBLE ELSE -value END, 5) + 0 AS v FROM events"

QUERIES["each_rows"] = tensor_query('$x >> reshape("8,8") >> each ($r) { cumsum } >> emit')
SQL["each_rows"] = f"SELECT vec_id, i, round(sum(x) OVER (PARTITION BY vec_id, i // 8 ORDER BY i), 6) + 0 AS v FROM {E}"
QUERIES["each_axis"] = tensor_query('$x >> reshape("8,8") >> each(axis=1) ($c) { cumsum >> mul(2) } >> emit')
SQL["each_axis"] = f"SELECT vec_id, i, round(2 * sum(x) OVER (PARTITION BY vec_id, i % 8 ORDER BY i), 6) + 0 AS v FROM {E}"

_DAG = '''$x >> abs >> $a
$a >> sum >> emit("total")
$a >> max >> $top
$top >> emit("top")
$x >> emit("early") >> mul(2) >> mean >> emit("late")
'''


def _dag(spark, sf_dir):
    out = Pipeline(text(_DAG)).run(lanes(spark, sf_dir), keep=["vec_id"])
    cols = [rounded(F.col(c), 6).alias(c) for c in ("total", "top", "late")]
    return out.select("vec_id", *cols, rounded(F.get(F.col("early")["data"], F.lit(5)), 6).alias("early"))


QUERIES["emits_and_taps"] = _dag
SQL["emits_and_taps"] = f"SELECT vec_id, round(sum(abs(x)), 6) + 0 AS total, round(max(abs(x)), 6) + 0 AS top, round(2 * avg(x), 6) + 0 AS late, round(max(x) FILTER (i = 5), 6) + 0 AS early FROM {E} GROUP BY vec_id"


def _defaults(spark, sf_dir):
    """A default, a bound constant and a column as an argument."""
    p = Pipeline(IMPORTS + "accept Scalar $value\naccept FloatArg $scale = 2.0\naccept IntArg $shift\n$value >> mul($scale) >> add($shift) >> emit\n")
    df = source(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 5).cast("int").alias("shift"))
    return p.run(df, keep=["event_id"]).select("event_id", rounded(F.col("output"), 5).alias("v"))


QUERIES["parameters"] = _defaults
SQL["parameters"] = "SELECT event_id, round(value * 2.0::DOUBLE + user_id % 5, 5) + 0 AS v FROM events"


def _bytes(spark, sf_dir):
    p = Pipeline("accept Bytes $b\n$b[4:60:2] >> emit\n")
    df = source(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return p.run(df, keep=["doc_id"]).select("doc_id", F.lower(F.hex("output")).alias("h"))


QUERIES["slice_bytes"] = _bytes
SQL["slice_bytes"] = "SELECT doc_id, array_to_string(list_transform(range(4, least(60, octet_length(encode(text))), 2), lambda k: substr(lower(hex(encode(text))), CAST(2 * k + 1 AS BIGINT), 2)), '') AS h FROM documents"


def _composite(spark, sf_dir):
    cell = lambda c: F.struct(F.array(F.lit(64).cast("long")).alias("shape"), c.alias("data"))
    df = lanes(spark, sf_dir).select("vec_id", F.struct(cell(F.col("x")).alias("_0"), cell(F.transform("x", F.abs)).alias("_1")).alias("pair"))
    return flat(Pipeline(text("$pair[1][2:6] >> neg >> emit", "accept Composite[Tensor[64], Tensor[64]] $pair")).run(df, keep=["vec_id"]))


QUERIES["composite_index"] = _composite
SQL["composite_index"] = f"SELECT vec_id, i - 2 AS i, round(-abs(x), 6) + 0 AS v FROM {E} WHERE i BETWEEN 2 AND 5"
