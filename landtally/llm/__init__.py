"""Operators of a training-data pipeline: deduplication, filtering, counting, scoring, mixing."""
