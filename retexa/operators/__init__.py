"""Reuse-detection operators; each takes and returns lazy DataFrames."""
