"""Headline workloads and queries, timed on local[$BENCH_CPUS] over $BENCH_SF_DIR.

Prints one JSON line. Plans are built and results written to the no-op sink
inside the timer, after one warm-up of each. The four workloads have their
published payload sizes; their inputs are made before the timer starts, and
``payloads_per_second`` stands beside that of a loop over the same kernels in
one process, which runs two of the payloads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from varve import Pipeline  # noqa: E402
from varve.queries import queries  # noqa: E402
from varve.queries.workloads import WORKLOADS  # noqa: E402

HEADLINE = ("flagship", "math_exp", "nn_softmax", "nn_layer_norm", "stats_std", "stats_cumsum", "tensor_transpose", "linalg_matmul", "linalg_inv", "nn_max_pool2d", "branch_route", "each_rows", "emits_and_taps", "audio_stft", "audio_biquad_filter", "image_gaussian_blur", "whole_matmul", "whole_softmax", "whole_gram", "whole_sum")


def host(cell):
    """A payload as the local interpreter takes it."""
    if isinstance(cell, (bytes, bytearray)):
        return bytes(cell)
    whole = isinstance(cell["data"][0], int)
    return np.array(cell["data"], "u1" if whole else "f4").reshape(cell["shape"])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, make) -> None:
        for _ in range(2):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 4)
        print(name, seconds[name], file=sys.stderr, flush=True)

    for name in HEADLINE:
        timed(name, lambda: queries()[name](spark, sf_dir))
    rates: dict[str, dict[str, float]] = {}
    for name, work in WORKLOADS.items():
        inputs = work.inputs(spark).persist()
        inputs.count()
        timed(name, lambda: work.run(inputs))
        payloads = [host(r[work.column]) for r in inputs.limit(2).collect()]
        pipeline = Pipeline(work.text)
        pipeline.run_local(payloads[0])
        began = time.perf_counter()
        for payload in payloads:
            pipeline.run_local(payload)
        alone = (time.perf_counter() - began) / len(payloads)
        rates[name] = {"payloads_per_second": round(work.count / seconds[name], 3), "one_process": round(1 / alone, 3)}
        inputs.unpersist()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "workloads": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
