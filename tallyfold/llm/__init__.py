"""Operators for preparing training data: deduplication, linking, neighbours, packing, mixing, sentences."""
