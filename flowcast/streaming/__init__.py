"""Structured Streaming forms of the batch operators (extension; the reference
reads its sources once and has no streaming)."""
