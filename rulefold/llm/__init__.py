"""Operators for preparing training data: formatting, deduplication, quality, tokens, mixing, packing, web archives."""
