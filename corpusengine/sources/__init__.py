"""Scans and sinks: corpora, pages, topics, chunk tables, the vector index, turns."""
