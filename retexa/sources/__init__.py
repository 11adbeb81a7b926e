"""Readers of text formats and writers of results."""
