"""Mergeable totals that a streaming job can fold with ``foreachBatch``."""
