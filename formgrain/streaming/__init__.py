"""Continuous intake of recognition results."""
