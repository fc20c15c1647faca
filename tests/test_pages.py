"""Pages as rows beside a book as one value."""

from __future__ import annotations

import random

from quarry.operators.pages import page_row_chunks
from quarry.sources.files import page_chunks


def test_rows_as_a_book(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["sea", "été", "wind. ", "sail", "ropes.", "North "])
    books = {}
    for b in "abc":
        pages = [(n, " ".join(word() for _ in range(rng.choice([1, 3, 40, 40, 1600, 2300])))) for n in range(1, 9)]
        books[b] = [(n, t if rng.random() > 0.2 else "  \n") for n, t in pages]
    rows = spark.createDataFrame([(b, n, t) for b, pages in books.items() for n, t in pages] + [("none", 1, None)], "document_id string, page_number int, text string").repartition(5)
    got = page_row_chunks(rows).collect()
    for b, pages in books.items():
        own = sorted((r.page_number, r.part, r.chunk_text, r.chunk_type) for r in got if r.document_id == b)
        want = page_chunks(pages)
        assert [(n, text, kind) for n, _, text, kind in own] == [(n, c.text, c.kind) for c, n in want]
    assert {r.document_id for r in got} == set(books)
    assert page_row_chunks(rows.limit(0)).count() == 0
