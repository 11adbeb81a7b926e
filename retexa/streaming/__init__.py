"""Streams of documents against a fixed index."""
