"""Operators of a training-data pipeline: dedup, extraction, labelling, packing, sharding."""
