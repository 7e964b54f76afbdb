"""Operators for preparing training corpora: deduplication, scoring, mixing, sharding, packing, search."""
