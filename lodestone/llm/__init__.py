"""Operators for large training-data pipelines. Nothing outside this package imports it."""
