"""Audio and images: embeddings as 64 samples or 8 x 8 gray pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Pipeline
from .common import E, Q, exact_lanes, flat, lanes, rounded, tensor_query, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
A = dict(dtype="float")
#: Queries whose results are exact in single precision on multiples of 1/256.
EXACT = frozenset("audio_gain audio_delay audio_to_wav_float audio_stereo_widen image_edge_sobel_x image_edge_laplacian image_morphology_gradient image_blend image_blend_screen image_color_adjust image_resize_area image_resize_bilinear".split())


def options(name: str) -> dict:
    return {"exact": True} if name in EXACT else A


def elements(name: str, sql: str) -> str:
    return sql.replace(E, Q).replace(E[:-1], Q[:-1]) if name in EXACT else sql

_WAVE = "round(greatest(least(x, 1), -1) * 32767)"
_LAG = "coalesce(lag(x, 4) OVER (PARTITION BY vec_id ORDER BY i), 0)"
for _name, _steps, _sql, _digits in [
    ("audio_gain", "gain(2)", "x * 2", 6), ("audio_gain_db", "gain(db=6.020599913279624)", "x * 2", 5), ("audio_normalize", "normalize(target_peak=0.5)", "x * 0.5::DOUBLE / max(abs(x)) OVER (PARTITION BY vec_id)", 4),
    ("audio_normalize_rms", 'normalize("rms", target_peak=0.1)', "x * 0.1::DOUBLE / sqrt(avg(x * x) OVER (PARTITION BY vec_id))", 3),
    ("audio_limiter_soft_clip", 'limiter(-6, mode="soft_clip")', "pow(10, -6 / 20.0::DOUBLE) * tanh(x / pow(10, -6 / 20.0::DOUBLE))", 4),
    ("audio_delay", "delay(0.5, feedback=0, mix=0.25)", f"0.75::DOUBLE * x + 0.25::DOUBLE * {_LAG}", 5),
    ("audio_to_pcm", 'to_pcm("i16") >> to_audio(8000, channels=1, normalize=false)', _WAVE, 3), ("audio_to_wav", "to_wav >> to_audio", f"{_WAVE} / 32768", 6),
    ("audio_to_wav_float", 'to_wav("f32") >> to_audio', "x", 6), ("audio_to_wav_24", "to_wav(24) >> to_audio", "round(greatest(least(x, 1), -1) * 8388607) / 8388608", 5),
]:
    QUERIES[_name] = tensor_query(f"$x >> to_audio(8000) >> {_steps} >> to_tensor >> emit", _digits, **options(_name))
    SQL[_name] = elements(_name, f"SELECT vec_id, i, round({_sql}, {_digits}) + 0 AS v FROM {E}")

QUERIES["audio_stereo_widen"] = tensor_query('$x >> reshape("2,32") >> to_audio(8000) >> stereo_widen(2) >> to_tensor >> emit', 5, exact=True)
SQL["audio_stereo_widen"] = elements("audio_stereo_widen", f"SELECT a.vec_id, a.i, round((a.x + b.x) / 2 + (a.x - b.x), 5) + 0 AS v FROM {E[:-1]}a JOIN {E[:-1]}b ON a.vec_id = b.vec_id AND b.i = (a.i + 32) % 64")
QUERIES["audio_to_audio"] = tensor_query('$x >> abs >> mul(1000) >> cast("u8") >> to_audio(8000) >> to_tensor >> emit', 6, whole=True, dtype="float")
SQL["audio_to_audio"] = "SELECT vec_id, i, round((least(abs(n) * 1000, 255) - 128) / 128.0::DOUBLE, 6) + 0 AS v FROM (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 16) AS BIGINT) AS n FROM embeddings) e"

# magnitudes by an explicit transform: 16 points, hop 8, symmetric Hann window
QUERIES["audio_stft"] = tensor_query("$x >> to_audio(8000) >> stft(16, hop_size=8) >> emit", 2, **A)
SQL["audio_stft"] = f"""
SELECT vec_id, CAST(b * 7 + f AS INTEGER) AS i, round(sqrt(pow(sum(w * x * cos(2 * pi() * b * k / 16)), 2) + pow(sum(w * x * sin(2 * pi() * b * k / 16)), 2)), 2) + 0 AS v
FROM {E}, (SELECT unnest(range(7)) AS f) f, (SELECT unnest(range(9)) AS b) b, (SELECT k, 0.5 * (1 - cos(2 * pi() * k / 15)) AS w FROM (SELECT unnest(range(16)) AS k)) k
WHERE i = f * 8 + k GROUP BY vec_id, b, f"""
QUERIES["audio_resample"] = tensor_query("$x >> to_audio(8000) >> resample(4000) >> to_tensor >> emit", 3, **A)
SQL["audio_resample"] = f"""
WITH w AS (
  SELECT vec_id, o, x, o * 2 AS c, 0.5 * (1 + cos(pi() * (i - o * 2) / 8)) * CASE WHEN i = o * 2 THEN 1 ELSE sin(pi() * 0.475::DOUBLE * (i - o * 2)) / (pi() * 0.475::DOUBLE * (i - o * 2)) END * 0.475::DOUBLE AS w
  FROM {E}, (SELECT unnest(range(32)) AS o) o WHERE abs(i - o * 2) <= 8
) SELECT vec_id, CAST(o AS INTEGER) AS i, round(sum(x * w) / sum(w), 3) + 0 AS v FROM w GROUP BY vec_id, o"""

# recurrences: a recursive sum states them
_BIQUAD = """
WITH RECURSIVE c0 AS (SELECT 2 * pi() * 1000 / 8000.0::DOUBLE AS w, 0.707::DOUBLE AS q), c1 AS (SELECT cos(w) AS c, sin(w) / (2 * q) AS a FROM c0),
k AS (SELECT (1 - c) / 2 / (1 + a) AS b0, (1 - c) / (1 + a) AS b1, -2 * c / (1 + a) AS a1, (1 - a) / (1 + a) AS a2 FROM c1),
s AS (SELECT vec_id, list(x ORDER BY i) AS xs FROM {e} GROUP BY vec_id),
r(vec_id, xs, i, y, s1, s2) AS (
  SELECT vec_id, xs, 0, b0 * xs[1], b1 * xs[1] - a1 * (b0 * xs[1]), b0 * xs[1] - a2 * (b0 * xs[1]) FROM s, k
  UNION ALL
  SELECT vec_id, xs, i + 1, b0 * xs[i + 2] + s1, b1 * xs[i + 2] - a1 * (b0 * xs[i + 2] + s1) + s2, b0 * xs[i + 2] - a2 * (b0 * xs[i + 2] + s1) FROM r, k WHERE i < 63
) SELECT vec_id, i, round(y, 4) + 0 AS v FROM r"""
QUERIES["audio_biquad_filter"] = tensor_query('$x >> to_audio(8000) >> biquad_filter("lowpass", freq=1000) >> to_tensor >> emit', 4, **A)
SQL["audio_biquad_filter"] = _BIQUAD.format(e=E)
_LIMIT = """
WITH RECURSIVE k AS (SELECT exp(-1 / (0.05::DOUBLE * 8000)) AS a, pow(10, -20 / 20.0::DOUBLE) AS c), s AS (SELECT vec_id, list(x ORDER BY i) AS xs FROM {e} GROUP BY vec_id),
r(vec_id, xs, i, env) AS (
  SELECT vec_id, xs, 0, abs(xs[1]) * CASE WHEN abs(xs[1]) > 0 THEN 1 ELSE 1 - a END FROM s, k
  UNION ALL SELECT vec_id, xs, i + 1, CASE WHEN abs(xs[i + 2]) > env THEN abs(xs[i + 2]) ELSE a * env + (1 - a) * abs(xs[i + 2]) END FROM r, k WHERE i < 63
) SELECT vec_id, i, round(greatest(least(xs[i + 1] * CASE WHEN env > c THEN c / env ELSE 1 END, c), -c), 4) + 0 AS v FROM r, k"""
QUERIES["audio_limiter"] = tensor_query("$x >> to_audio(8000) >> limiter(-20) >> to_tensor >> emit", 4, **A)
SQL["audio_limiter"] = _LIMIT.format(e=E)
_COMPRESS = """
WITH RECURSIVE k AS (SELECT exp(-1 / (0.01::DOUBLE * 8000)) AS fast, exp(-1 / (0.1::DOUBLE * 8000)) AS slow),
g AS (SELECT vec_id, list(x ORDER BY i) AS xs, list(CASE WHEN 2 * o < -2 THEN 0 WHEN 2 * abs(o) <= 2 THEN -0.75::DOUBLE * (o + 1) * (o + 1) / 4 ELSE -0.75::DOUBLE * o END ORDER BY i) AS gs
  FROM (SELECT vec_id, i, x, 20 * log10(greatest(abs(x), 1e-6::DOUBLE)) + 30 AS o FROM {e}) GROUP BY vec_id),
r(vec_id, xs, gs, i, env) AS (
  SELECT vec_id, xs, gs, 0, slow * -96 + (1 - slow) * gs[1] FROM g, k
  UNION ALL SELECT vec_id, xs, gs, i + 1, CASE WHEN gs[i + 2] < env THEN fast * env + (1 - fast) * gs[i + 2] ELSE slow * env + (1 - slow) * gs[i + 2] END FROM r, k WHERE i < 63
) SELECT vec_id, i, round(xs[i + 1] * pow(10, env / 20) * 1000, 3) + 0 AS v FROM r"""
QUERIES["audio_compressor"] = tensor_query("$x >> to_audio(8000) >> compressor(threshold_db=-30) >> gain(1000) >> to_tensor >> emit", 3, **A)
SQL["audio_compressor"] = _COMPRESS.format(e=E)
_GATE = """
WITH RECURSIVE k AS (SELECT exp(-1 / (0.002::DOUBLE * 8000)) AS fast, exp(-1 / (0.05::DOUBLE * 8000)) AS slow),
g AS (SELECT vec_id, list(x ORDER BY i) AS xs, list(l ORDER BY i) AS ls FROM (SELECT vec_id, i, x, CASE WHEN abs(x) <= 1e-6::DOUBLE THEN -120 ELSE 20 * log10(greatest(abs(x), 1e-6::DOUBLE)) END AS l FROM {e}) GROUP BY vec_id),
r(vec_id, xs, ls, i, env) AS (
  SELECT vec_id, xs, ls, 0, (1 - fast) * CASE WHEN ls[1] >= -20 THEN 1 ELSE pow(10, -(-20 - ls[1]) * 3 / 20) END FROM g, k
  UNION ALL
  SELECT vec_id, xs, ls, i + 1, CASE WHEN t > env THEN fast * env + (1 - fast) * t ELSE slow * env + (1 - slow) * t END
  FROM (SELECT *, CASE WHEN ls[i + 2] >= -20 THEN 1 ELSE pow(10, -(-20 - ls[i + 2]) * 3 / 20) END AS t FROM r, k) WHERE i < 63
) SELECT vec_id, i, round(xs[i + 1] * env, 4) + 0 AS v FROM r"""
QUERIES["audio_noise_gate"] = tensor_query("$x >> to_audio(8000) >> noise_gate(threshold_db=-20, ratio=4, hold_ms=0) >> to_tensor >> emit", 4, **A)
SQL["audio_noise_gate"] = _GATE.format(e=E)

# images: SQL of the source pixel (r, c) of each output pixel
G = "(SELECT vec_id, i // 8 AS r, i % 8 AS c, x FROM " + E + ") g"


def _gather(name: str, steps: str, h: int, w: int, r: str, c: str, twin: str = "") -> None:
    QUERIES[name] = tensor_query(f'$x >> reshape("8,8") >> {steps} >> emit', 6, **A)
    SQL[name] = f"SELECT o.vec_id, CAST(o.r * {w} + o.c AS INTEGER) AS i, round(g.x, 6) + 0 AS v FROM (SELECT vec_id, r, c FROM embeddings, (SELECT unnest(range({h})) AS r) r, (SELECT unnest(range({w})) AS c) c) o JOIN {G} ON g.vec_id = o.vec_id AND g.r = {r} AND g.c = {c}"


_gather("image_flip", "flip", 8, 8, "o.r", "7 - o.c")
_gather("image_flip_vertical", 'flip("vertical")', 8, 8, "7 - o.r", "o.c")
_gather("image_crop", "crop(2, 1, 4, 5)", 5, 4, "o.r + 1", "o.c + 2")
_gather("image_pad_edge", 'pad(2, mode="edge")', 12, 12, "greatest(least(o.r - 2, 7), 0)", "greatest(least(o.c - 2, 7), 0)")
_gather("image_pad_reflect", 'pad(1, mode="reflect")', 10, 10, "CASE WHEN o.r = 0 THEN 1 WHEN o.r = 9 THEN 6 ELSE o.r - 1 END", "CASE WHEN o.c = 0 THEN 1 WHEN o.c = 9 THEN 6 ELSE o.c - 1 END")
_gather("image_rotate", "rotate(90)", 8, 8, "7 - o.c", "o.r")
_gather("image_rotate_half", "rotate(180)", 8, 8, "7 - o.r", "7 - o.c")
_gather("image_resize_nearest", 'resize(4, 16, filter="nearest")', 16, 4, "o.r // 2", "o.c * 2")

_near = lambda dy, dx: f"max(x) FILTER (p = {(dy + 1) * 3 + dx + 1})"
#: Each pixel with its nine neighbours, borders repeated: p = 0 .. 8.
_NINE = f"(SELECT o.vec_id, o.r * 8 + o.c AS i, p, g.x FROM {G.replace(') g', ') o')}, (SELECT unnest(range(9)) AS p) p JOIN {G} ON g.vec_id = o.vec_id AND g.r = greatest(least(o.r + p // 3 - 1, 7), 0) AND g.c = greatest(least(o.c + p % 3 - 1, 7), 0)) n"
_GX = f"({_near(-1, 1)} + 2 * {_near(0, 1)} + {_near(1, 1)} - {_near(-1, -1)} - 2 * {_near(0, -1)} - {_near(1, -1)})"
_GY = f"({_near(1, -1)} + 2 * {_near(1, 0)} + {_near(1, 1)} - {_near(-1, -1)} - 2 * {_near(-1, 0)} - {_near(-1, 1)})"
_w = lambda s: f"(CASE p WHEN 4 THEN 1 WHEN 1 THEN {s} WHEN 3 THEN {s} WHEN 5 THEN {s} WHEN 7 THEN {s} ELSE {s} * {s} END)"
_H = "exp(-0.5::DOUBLE)"
_BLUR = f"sum(x * {_w(_H)}) / sum({_w(_H)})"
for _name, _steps, _sql, _digits in [
    ("image_blur_box", 'gaussian_blur(radius=1, mode="box")', "avg(x)", 3), ("image_gaussian_blur", "gaussian_blur(1, radius=1)", _BLUR, 3), ("image_sharpen", "sharpen(0.5, radius=1)", f"{_near(0, 0)} + 0.5::DOUBLE * ({_near(0, 0)} - {_BLUR})", 4),
    ("image_edge_sobel", 'edge_detect("sobel")', f"sqrt({_GX} * {_GX} + {_GY} * {_GY})", 3), ("image_edge_sobel_x", 'edge_detect("sobel_x")', f"abs({_GX})", 5),
    ("image_edge_laplacian", 'edge_detect("laplacian")', f"abs({_near(-1, 0)} + {_near(1, 0)} + {_near(0, -1)} + {_near(0, 1)} - 4 * {_near(0, 0)})", 5),
    ("image_morphology", 'morphology("dilate")', "max(x)", 6), ("image_morphology_erode", 'morphology("erode", shape="cross")', "min(x) FILTER (p IN (1, 3, 4, 5, 7))", 6), ("image_morphology_gradient", 'morphology("gradient")', "max(x) - min(x)", 5),
]:
    QUERIES[_name] = tensor_query(f'$x >> reshape("8,8") >> {_steps} >> emit', _digits, **options(_name))
    SQL[_name] = elements(_name, f"SELECT vec_id, CAST(i AS INTEGER) AS i, round({_sql}, {_digits}) + 0 AS v FROM {_NINE} GROUP BY vec_id, i")

for _name, _steps, _sql, _digits in [
    ("image_threshold", "threshold(0.05)", "CASE WHEN x >= 0.05::FLOAT THEN 1 ELSE 0 END::DOUBLE", 6), ("image_threshold_to_zero", 'threshold(0.05, mode="to_zero")', "CASE WHEN x >= 0.05::FLOAT THEN x ELSE 0 END", 6),
    ("image_threshold_truncate", 'threshold(0.0625, mode="truncate")', "least(x, 0.0625::DOUBLE)", 6),
    ("image_blend", 'blend("multiply", color="0.5", opacity=0.5)', "0.5::DOUBLE * x + 0.5::DOUBLE * x * 0.5::DOUBLE", 5), ("image_blend_screen", 'blend("screen", color="0.25")', "1 - (1 - x) * 0.75::DOUBLE", 5),
    ("image_color_adjust", "color_adjust(brightness=0.25, contrast=2)", "(x - 0.5::DOUBLE) * 2 + 0.75::DOUBLE", 5),
    ("image_to_image", "abs >> to_image >> to_tensor", "round(least(abs(x), 1) * 255) / 255", 5),
]:
    QUERIES[_name] = tensor_query(f'$x >> reshape("8,8") >> {_steps} >> emit', _digits, **options(_name))
    SQL[_name] = elements(_name, f"SELECT vec_id, i, round({_sql}, {_digits}) + 0 AS v FROM {E}")

QUERIES["base_to_tensor"] = tensor_query('$x >> reshape("8,8") >> abs >> to_tensor(dtype="u8") >> emit', 3, **A)
SQL["base_to_tensor"] = f"SELECT vec_id, i, round(least(abs(x), 1) * 255) + 0 AS v FROM {E}"
QUERIES["image_resize_area"] = tensor_query('$x >> reshape("8,8") >> resize(4, 4, filter="area") >> emit', 5, exact=True)
SQL["image_resize_area"] = elements("image_resize_area", f"SELECT vec_id, CAST((r // 2) * 4 + c // 2 AS INTEGER) AS i, round(avg(x), 5) + 0 AS v FROM {G} GROUP BY vec_id, (r // 2) * 4 + c // 2")
# half-size bilinear samples lie between two pixels on each axis
QUERIES["image_resize_bilinear"] = tensor_query('$x >> reshape("8,8") >> resize(4, 4) >> emit', 5, exact=True)
SQL["image_resize_bilinear"] = SQL["image_resize_area"]

# accelerated twins
_PLUGIN = "plugin opencv-bridge/0.1.0\nimport image_opencv/latest\nimport tensor_basics/latest\naccept Tensor[64] $x\n"
for _of in ("rotate", "resize_bilinear", "gaussian_blur", "morphology", "edge_sobel", "sharpen"):
    _steps = {"rotate": "rotate(90)", "resize_bilinear": "resize(4, 4)", "gaussian_blur": "gaussian_blur(1, radius=1)", "morphology": 'morphology("dilate")', "edge_sobel": 'edge_detect("sobel")', "sharpen": "sharpen(0.5, radius=1)"}[_of]
    _digits = {"rotate": 6, "morphology": 6, "resize_bilinear": 5, "gaussian_blur": 3, "edge_sobel": 3}.get(_of, 4)
    QUERIES[f"opencv_{_of}"] = (lambda steps, digits, exact: lambda spark, sf_dir: flat(Pipeline(_PLUGIN + f'$x >> reshape("8,8") >> {steps} >> emit\n').run(exact_lanes(spark, sf_dir) if exact else lanes(spark, sf_dir, "float"), keep=["vec_id"]), digits))(_steps, _digits, f"image_{_of}" in EXACT)
    SQL[f"opencv_{_of}"] = SQL[f"image_{_of}"]


def _enhance(spark, sf_dir):
    """A pipeline of image steps on RGB pixels, without SQL."""
    program = text('$x >> reshape("4,4,4") >> abs >> resize(8, 8, filter="bicubic") >> rotate(30) >> color_adjust(saturation=1.5, gamma=2) >> threshold(mode="otsu") >> emit')
    out = Pipeline(program).run(lanes(spark, sf_dir, "float"), keep=["vec_id"])
    return out.select("vec_id", F.size(F.col("output")["data"]).alias("n"), rounded(F.aggregate(F.col("output")["data"], F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


QUERIES["image_enhance"] = _enhance
