"""Readers: files of many formats to texts and chunks."""
