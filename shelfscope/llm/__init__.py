"""Operators for training-data pipelines: deduplication, quality, safety, token and archive files."""
