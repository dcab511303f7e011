"""Operators of a training-data pipeline: tokens, packing, duplicates, quality, language, personal data, shards."""
