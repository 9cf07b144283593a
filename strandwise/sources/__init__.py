"""Readers and writers around Spark's own sources."""
