"""Schemas of the stored tables, as (column, type) pairs."""

from __future__ import annotations

TABLES: dict[str, dict[str, str]] = {
    "documents": {
        "id": "string",
        "original_text": "string",
        "content_hash": "string",
        "file_path": "string",
        "source_path": "string",
        "doc_type": "string",
        "chunk_count": "int",
        "created_at": "timestamp",
        "updated_at": "timestamp",
    },
    "chunks": {
        "chunk_id": "string",
        "document_id": "string",
        "chunk_index": "int",
        "chunk_text": "string",
        "start_pos": "int",
        "end_pos": "int",
        "token_count": "int",
        "page_number": "int",
        "chunk_type": "string",
        "created_at": "timestamp",
    },
    "embeddings": {"chunk_id": "string", "document_id": "string", "embedding": "array<float>"},
    # the keyword index: ``n`` is 1 for a word that came into a document and -1 for one that left it
    "postings": {"word": "string", "document_id": "string", "n": "int"},
    "words": {"word": "string"},
    # the files that were indexed, as they were then
    "files": {"path": "string", "length": "bigint", "modified_at": "timestamp", "content_hash": "string", "document_id": "string"},
}

#: The column by which a table's rows are placed; of the first three it holds a document's id.
KEYS = {"documents": "id", "chunks": "document_id", "embeddings": "document_id", "postings": "word", "words": "word", "files": "path"}


def ddl(table: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in TABLES[table].items())
