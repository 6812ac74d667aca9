"""Query of best-fit-decreasing token matrices."""

from __future__ import annotations

from .bfd import digest, token_matrices
from .common import table
from .tokens import default_path


def op6(spark, sf_dir):
    return digest(token_matrices(table(spark, sf_dir, "documents"), default_path()))


QUERIES = {"op6_token_matrices": op6}
