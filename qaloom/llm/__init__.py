"""Operators of a training-data pipeline: tokens, near duplicates, quality, packing, search and output files."""
