"""Operators for preparing training text: extraction, deduplication, scoring, filtering, mixing and sharding."""
