"""Table functions for SQL: ``select ... from docs, lateral chunk_text(text, 256, 38)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.session import ship


class ChunkText:
    def eval(self, text: str, max_tokens: int, overlap: int) -> Iterator[tuple]:
        from quarry.operators.units import Chunker

        for i, c in enumerate(Chunker(max_tokens, overlap).chunk(text)):
            yield i, c.text, c.token_count, c.kind


class HtmlSections:
    def eval(self, page: str) -> Iterator[tuple]:
        from quarry.sources import html

        for i, s in enumerate(html.sections(html.parse(page or ""))):
            yield i, s


FUNCTIONS = {
    "chunk_text": (ChunkText, "chunk_index int, chunk_text string, token_count int, chunk_type string"),
    "html_sections": (HtmlSections, "section int, section_text string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    ship(spark)
    for name, (body, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(body, returnType=schema))
