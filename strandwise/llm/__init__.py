"""Operators of a training-data pipeline: search, counting, deduplication, mixing, packing, language, secrets."""
