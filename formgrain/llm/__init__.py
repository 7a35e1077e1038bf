"""Operators of a training-data pipeline: filtering, deduplication, counting, scoring."""
