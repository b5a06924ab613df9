"""Relational operators: ids, structure, chunks, dedup, search, memory, model application."""
