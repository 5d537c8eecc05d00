"""Operators of a training-data pipeline: packing, deduplication, extraction, search, toxicity and mixing."""
