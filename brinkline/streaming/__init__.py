"""Structured Streaming forms of the extractor."""
