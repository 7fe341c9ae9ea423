"""Structured Streaming forms: the same folds and aggregates over streams."""
