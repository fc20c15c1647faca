"""Composite plans: indexing, retrieval, and chat."""
