"""Query of HTML extraction."""

from __future__ import annotations

from .common import table
from .html_text import main_text


def op8(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8}
