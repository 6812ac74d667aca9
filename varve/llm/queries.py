"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_merkle", "q_fingerprints", "q_kdtree", "q_simhash", "q_mixing", "q_bfd", "q_pack", "q_html", "q_toxicity", "q_lines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f".{m}", __package__).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f".{m}", __package__), "SQL", {})
    return out
