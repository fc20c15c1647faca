"""Structured Streaming: continuous ingest and event windows."""
