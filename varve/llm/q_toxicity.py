"""Query of the toxicity model."""

from __future__ import annotations

from .common import table
from .toxicity import fitted, scored


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9}
