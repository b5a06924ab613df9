"""Structured Streaming forms of index sync, deduplication and conversation memory."""
