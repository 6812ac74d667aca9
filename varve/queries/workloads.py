"""The four benchmark workloads at their published sizes, each over payloads held in rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..engine import Pipeline

#: 1920 x 1080: the middle three quarters, mirrored, 512 x 512, to unit floats.
IMAGE = """
import base/latest
import image_basics/latest
accept Tensor[*,*,3] $picture
$picture >> crop(240, 135, 1440, 810) >> flip >> resize(512, 512, filter="nearest") >> to_tensor >> emit
"""

SEQUENTIAL = "import linalg_basics/latest\nimport tensor_basics/latest\naccept Tensor[256,256] $m\n$m" + " >> inv >> transpose" * 12 + " >> cholesky >> emit\n"

#: 16 branches from one shared step, two outputs each.
BRANCHING = "import math_basics/latest\nimport nn_basics/latest\nimport tensor_stats/latest\naccept Tensor[512,512] $x\n$x >> mul(0.5) >> add(0.25) >> $shared\n" + "".join(
    f'$shared >> mul({k + 1}) >> add(0.{k + 1}) >> relu >> clamp(0, 4) >> tanh >> $m{k}\n$m{k} >> emit("matrix_{k}")\n$m{k} >> abs >> sum(axis=1) >> emit("rows_{k}")\n' for k in range(16))

AUDIO = """
import audio_basics/latest
accept Bytes $wav
$wav >> to_audio >> resample(16000) >> biquad_filter("highpass", freq=80) >> normalize(target_peak=0.9) >> $clean
$clean >> stft(512, hop_size=160) >> emit("spectrogram")
$clean >> to_wav >> emit("wav")
"""


@dataclass(frozen=True)
class Workload:
    """A pipeline, its input rows (id and one payload) and how many there are."""

    text: str
    payloads: Any
    column: str
    count: int

    def inputs(self, spark: SparkSession) -> DataFrame:
        return self.payloads(spark.range(self.count).repartition(min(self.count, 8)))

    def run(self, df: DataFrame) -> DataFrame:
        return Pipeline(self.text).run(df, keep=["id"])


def _made(ids: DataFrame, name: str, element: str, make) -> DataFrame:
    """A tensor cell for each id, by a numpy function of it."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                x = make(i)
                cell = pa.StructArray.from_arrays([pa.array([list(x.shape)], pa.list_(pa.int64())), pa.array([x.reshape(-1)])], names=["shape", "data"])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), cell], names=["id", name])

    return ids.select("id").mapInArrow(run, f"id long, {name} struct<shape:array<bigint>,data:array<{element}>>")


def _pictures(ids: DataFrame) -> DataFrame:
    make = lambda i: ((np.arange(1080 * 1920 * 3) * 31 + i * 17) % 256).astype("i2").reshape(1080, 1920, 3)
    return _made(ids, "picture", "smallint", make).withMetadata("picture", {"dtype": "u8"})


def _positive(i: int) -> np.ndarray:
    """Positive definite: a heavy diagonal, symmetric elsewhere."""
    k = np.arange(256)
    low, high = np.minimum(k[:, None], k), np.maximum(k[:, None], k)
    return np.where(low == high, 300.0, ((low * 13 + high * 7 + i) % 7) / 7).astype("f4")


def _planes(ids: DataFrame) -> DataFrame:
    return _made(ids, "x", "float", lambda i: (((np.arange(512 * 512) * 13 + i) % 1000) / 500 - 1).astype("f4").reshape(512, 512))


def _clips(ids: DataFrame) -> DataFrame:
    """10 s in stereo at 44.1 kHz, as wave files."""
    step = np.arange(441_000) * (2 * math.pi / 440)
    sound = _made(ids, "x", "float", lambda i: np.stack([0.5 * np.sin(step * (i % 40 + f)) for f in (3, 5)]).astype("f4"))
    return Pipeline("import audio_basics/latest\naccept Tensor[2,*] $x\n$x >> to_audio(44100) >> to_wav >> emit(\"wav\")\n").run(sound, keep=["id"])


WORKLOADS = {
    "workload_image": Workload(IMAGE, _pictures, "picture", 16),
    "workload_sequential": Workload(SEQUENTIAL, lambda ids: _made(ids, "m", "float", _positive), "m", 16),
    "workload_branching": Workload(BRANCHING, _planes, "x", 8),
    "workload_audio": Workload(AUDIO, _clips, "wav", 16),
}
