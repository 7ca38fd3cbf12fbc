"""Operators of a training-data pipeline: search, language, extraction, duplicates, quality, leaks, shards, archives, packing."""
