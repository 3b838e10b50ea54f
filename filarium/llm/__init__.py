"""Operators of a training-data pipeline: quality, tokens, archives, secrets, dedup, urls, packing, search."""
