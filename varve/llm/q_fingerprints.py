"""Query of document fingerprints."""

from __future__ import annotations

from .common import table
from .fingerprints import edited_pairs


def op2(spark, sf_dir):
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op2_document_fingerprints": op2}
