"""Operators of a training-data pipeline (fingerprints, dedup, mixing, tokens, scoring)."""
