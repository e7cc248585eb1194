"""Readers and writers: motion clips, models, metadata."""
