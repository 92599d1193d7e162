"""Operators for training-data pipelines (token storage, deduplication,
sanitising, filtering, scoring).  Nothing outside this package imports it."""
