"""Queries of the packing operators."""

from __future__ import annotations

from .common import table
from .packing import packed
from .tokens import default_path


def op7(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op7_best_fit_packing": op7}
