"""Reductions, scans, normalizations and movements of lanes and 8 x 8 tensors."""

from __future__ import annotations

from .common import E, N, scalar_query, tensor_query

QUERIES: dict = {}
SQL: dict[str, str] = {}

for _name, _steps, _sql in [
    ("stats_sum", "sum", "sum(x)"), ("stats_mean", "mean", "avg(x)"), ("stats_var", "var", "var_samp(x)"), ("stats_var_population", "var(unbiased=false)", "var_pop(x)"),
    ("stats_std", "std", "stddev_samp(x)"), ("stats_min", "min", "min(x)"), ("stats_max", "max", "max(x)"), ("stats_norm", "norm", "sqrt(sum(x * x))"),
    ("stats_norm_1", "norm(1)", "sum(abs(x))"), ("stats_norm_inf", 'norm("inf")', "max(abs(x))"), ("stats_norm_3", "norm(p=3)", "pow(sum(pow(abs(x), 3)), 1.0::DOUBLE / 3)"),
]:
    QUERIES[_name] = scalar_query(f"$x >> {_steps} >> emit")
    SQL[_name] = f"SELECT vec_id, round({_sql}, 6) + 0 AS v FROM {E} GROUP BY vec_id"

for _name, _f in (("stats_argmin", "arg_min"), ("stats_argmax", "arg_max")):
    QUERIES[_name] = tensor_query(f"$x >> {_name[6:]} >> emit")
    SQL[_name] = f"SELECT vec_id, 0 AS i, CAST({_f}(i, x) AS DOUBLE) AS v FROM {E} GROUP BY vec_id"

# along an axis of [8, 8]
for _name, _steps, _sql, _key in [
    ("stats_sum_axis0", "sum(axis=0)", "sum(x)", "i % 8"), ("stats_mean_axis1", "mean(axis=1)", "avg(x)", "i // 8"), ("stats_std_axis0", "std(axis=0)", "stddev_samp(x)", "i % 8"),
    ("stats_max_keepdim", "max(axis=-1, keepdim=true)", "max(x)", "i // 8"), ("stats_argmax_axis0", "argmax(axis=0)", "arg_max(i // 8, x)", "i % 8"), ("stats_norm_axis1", "norm(2, axis=1)", "sqrt(sum(x * x))", "i // 8"),
]:
    QUERIES[_name] = tensor_query(f'$x >> reshape("8,8") >> {_steps} >> emit')
    SQL[_name] = f"SELECT vec_id, CAST({_key} AS INTEGER) AS i, round(CAST({_sql} AS DOUBLE), 6) + 0 AS v FROM {E} GROUP BY vec_id, {_key}"

for _name, _steps, _sql in [
    ("stats_cumsum", "cumsum", "sum(x) OVER (PARTITION BY vec_id ORDER BY i)"),
    ("stats_cumsum_axis1", 'reshape("8,8") >> cumsum(axis=1)', "sum(x) OVER (PARTITION BY vec_id, i // 8 ORDER BY i)"),
    ("nn_softmax", "softmax", "exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id)"),
    ("nn_softmax_axis0", 'reshape("8,8") >> softmax(axis=0)', "exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id, i % 8)"),
    ("nn_log_softmax", "log_softmax", "x - ln(sum(exp(x)) OVER (PARTITION BY vec_id))"),
    ("nn_layer_norm", "layer_norm", "(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5::DOUBLE)"),
    ("nn_rms_norm", "rms_norm", "x / sqrt(avg(x * x) OVER w + 1e-5::DOUBLE)"),
]:
    QUERIES[_name] = tensor_query(f"$x >> {_steps} >> emit", 5)
    SQL[_name] = f"SELECT vec_id, i, round({_sql}, 5) + 0 AS v FROM {E} WINDOW w AS (PARTITION BY vec_id)"

# movements: SQL of the source place of element i
for _name, _steps, _size, _from in [
    ("tensor_reshape", 'reshape("[4,-1]")', 64, "i"), ("tensor_flatten", 'reshape("2,4,8") >> flatten(0, 1)', 64, "i"), ("tensor_squeeze", 'reshape("1,64,1") >> squeeze', 64, "i"), ("tensor_unsqueeze", "unsqueeze(-1)", 64, "i"),
    ("tensor_transpose", 'reshape("8,8") >> transpose', 64, "(i % 8) * 8 + i // 8"), ("tensor_permute", 'reshape("2,4,8") >> permute("2,0,1")', 64, "((i // 4) % 2) * 32 + (i % 4) * 8 + i // 8"),
    ("tensor_roll", "roll(5)", 64, "(i + 59) % 64"), ("tensor_roll_axis1", 'reshape("8,8") >> roll(-3, axis=1)', 64, "(i // 8) * 8 + (i + 3) % 8"), ("tensor_repeat", 'repeat("2")', 128, "i % 64"),
]:
    QUERIES[_name] = tensor_query(f"$x >> {_steps} >> emit")
    SQL[_name] = f"SELECT o.vec_id, o.i, round(e.x, 6) + 0 AS v FROM (SELECT vec_id, CAST(unnest(range({_size})) AS INTEGER) AS i FROM embeddings) o JOIN {E} ON e.vec_id = o.vec_id AND e.i = {_from.replace('i', 'o.i')}"

# twins
for _name, _twin, _of in (("blas_repeat", 'repeat("2")', "tensor_repeat"), ("blas_roll", "roll(5)", "tensor_roll")):
    QUERIES[_name] = tensor_query(f"$x >> {_twin} >> emit", twins=True)
    SQL[_name] = SQL[_of]

for _name, _twins in (("tensor_concat", False), ("blas_concat", True)):
    QUERIES[_name] = (lambda twins: lambda spark, sf_dir: _concat(spark, sf_dir, twins))(_twins)
    SQL[_name] = f"SELECT vec_id, CAST(i + k * 64 AS INTEGER) AS i, round(CASE k WHEN 0 THEN x ELSE abs(x) END, 6) + 0 AS v FROM {E}, (SELECT unnest([0, 1]) AS k) k"


def _concat(spark, sf_dir, twins):
    from pyspark.sql import functions as F

    from ..engine import Pipeline
    from .common import flat, lanes, text

    cell = lambda c: F.struct(F.array(F.lit(64).cast("long")).alias("shape"), c.alias("data"))
    df = lanes(spark, sf_dir).select("vec_id", F.struct(cell(F.col("x")).alias("_0"), cell(F.transform("x", F.abs)).alias("_1")).alias("pair"))
    return flat(Pipeline(text("$pair >> concat >> emit", "accept Composite[Tensor[64], Tensor[64]] $pair", twins)).run(df, keep=["vec_id"]))


# pooling of [8, 8]
for _name, _f in (("nn_max_pool2d", "max"), ("nn_avg_pool2d", "avg")):
    QUERIES[_name] = tensor_query(f'$x >> reshape("8,8") >> {_name[3:]}(2, 2) >> emit')
    SQL[_name] = f"SELECT vec_id, CAST((i // 16) * 4 + (i % 8) // 2 AS INTEGER) AS i, round({_f}(x), 6) + 0 AS v FROM {E} GROUP BY vec_id, (i // 16) * 4 + (i % 8) // 2"

# exact statistics of integers
for _name, _steps, _sql in [("integer_sum", "sum", "CAST(sum(n) AS DOUBLE)"), ("integer_mean", "mean", "avg(n)"), ("integer_std", "std", "stddev_samp(n)"), ("integer_norm", "norm", "sqrt(sum(n * n))")]:
    QUERIES[_name] = scalar_query(f'$x >> cast("i32") >> {_steps} >> emit', whole=True)
    SQL[_name] = f"SELECT vec_id, round({_sql}, 6) + 0 AS v FROM {N} GROUP BY vec_id"
