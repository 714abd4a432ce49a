"""Operators of a training-data pipeline: media, tokens, quality, dedup, PII."""
