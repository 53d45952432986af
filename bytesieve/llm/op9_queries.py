"""Visible text of the pages table."""

from __future__ import annotations

from bytesieve.llm.html_text import extracted
from bytesieve.llm.tables import read


def op9_html_text(spark, sf_dir):
    return extracted(read(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
