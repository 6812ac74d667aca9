"""Query of SimHash near-dedup."""

from __future__ import annotations

from .common import table
from .simhash_dedup import near_duplicates


def op4(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_near_dedup": op4}
