"""Incremental training on streams."""
