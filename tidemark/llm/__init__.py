"""Operators of a training-data pipeline: mixing, quality, privacy, token output, licences,
near and exact duplicates, tokenising and language."""
