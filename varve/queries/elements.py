"""Element-wise actions."""

from __future__ import annotations

from .common import E, N, tensor_query

# action: steps, SQL of one element x
CASES = {
    "math_add": ("add(0.5)", "x + 0.5"),
    "math_sub": ("sub(value=0.25)", "x - 0.25"),
    "math_mul": ("mul(3)", "x * 3"),
    "math_div": ("div(by=4)", "x / 4"),
    "math_pow": ("pow(2)", "pow(x, 2)"),
    "math_clamp": ("clamp(-0.1, 0.1)", "greatest(least(x, 0.1::DOUBLE), -0.1::DOUBLE)"),
    "math_abs": ("abs", "abs(x)"),
    "math_sign": ("sign", "CAST(sign(x) AS DOUBLE)"),
    "math_neg": ("neg", "-x"),
    "math_sqrt": ("sqrt", "sqrt(greatest(x, 0::DOUBLE))"),
    "math_rsqrt": ("abs >> rsqrt(0.01)", "1 / sqrt(greatest(abs(x) + 0.01::DOUBLE, 0.01::DOUBLE))"),
    "math_exp": ("exp", "exp(x)"),
    "math_log": ("abs >> log", "ln(greatest(abs(x) + 1e-8::DOUBLE, 1e-8::DOUBLE))"),
    "math_log2": ("abs >> log(2, eps=0.001)", "log2(greatest(abs(x) + 0.001::DOUBLE, 0.001::DOUBLE))"),
    "math_log10": ("abs >> log(base=10, eps=0.001)", "log10(greatest(abs(x) + 0.001::DOUBLE, 0.001::DOUBLE))"),
    "math_sin": ("sin", "sin(x)"),
    "math_cos": ("cos", "cos(x)"),
    "math_tan": ("tan", "tan(x)"),
    "nn_relu": ("relu", "greatest(x, 0::DOUBLE)"),
    "nn_leaky_relu": ("leaky_relu(alpha=0.1)", "CASE WHEN x >= 0 THEN x ELSE x * 0.1::DOUBLE END"),
    "nn_gelu_tanh": ('gelu("tanh")', "0.5::DOUBLE * x * (1 + tanh(0.7978845608028654::DOUBLE * (x + 0.044715::DOUBLE * x * x * x)))"),
    "nn_sigmoid": ("sigmoid", "1 / (1 + exp(-x))"),
    "nn_silu": ("silu", "x / (1 + exp(-x))"),
    "nn_tanh": ("tanh", "tanh(x)"),
    "base_identity": ("identity", "x"),
}

QUERIES = {k: tensor_query(f"$x >> {steps} >> emit") for k, (steps, _) in CASES.items()}
SQL = {k: f"SELECT vec_id, i, round({e}, 6) + 0 AS v FROM {E}" for k, (_, e) in CASES.items()}

_T = "(1 / (1 + 0.3275911::DOUBLE * abs(x / sqrt(2::DOUBLE))))"
_POLY = "0::DOUBLE"
for _a in ("1.061405429", "-1.453152027", "1.421413741", "-0.284496736", "0.254829592"):
    _POLY = f"(({_POLY} + {_a}::DOUBLE) * {_T})"
QUERIES["nn_gelu"] = tensor_query("$x >> gelu >> emit", 4, dtype="float")
SQL["nn_gelu"] = f"SELECT vec_id, i, round(0.5::DOUBLE * x * (1 + sign(x) * (1 - {_POLY} * exp(-x * x / 2))), 4) + 0 AS v FROM {E}"

# casts and integers: exact on both sides
_INTS = {
    "tensor_cast": ('mul(100) >> cast("u8")', "greatest(least(round(n * 100.0::DOUBLE), 255), 0)"),
    "tensor_cast_i8": ('mul(40) >> cast("i8")', "greatest(least(round(n * 40.0::DOUBLE), 127), -128)"),
    "integer_add": ('cast("i32") >> add(7)', "n + 7"),
    "integer_mul_wraps": ('cast("i8") >> mul(100)', "((n * 100 + 128) % 256 + 256) % 256 - 128"),
    "integer_pow": ('cast("i64") >> pow(3)', "n * n * n"),
    "integer_div": ('cast("i32") >> div(4)', "n / 4.0::DOUBLE"),
}
QUERIES |= {k: tensor_query(f"$x >> {steps} >> emit", whole=True, dtype="double") for k, (steps, _) in _INTS.items()}
SQL |= {k: f"SELECT vec_id, i, round(CAST({e} AS DOUBLE), 6) + 0 AS v FROM {N}" for k, (_, e) in _INTS.items()}
