"""Operators of a training-data pipeline: language, quality, duplicates, mixing, shards."""
