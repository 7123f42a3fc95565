"""Operators for preparing training corpora: deduplication, filtering, scoring, mixing and packing."""
