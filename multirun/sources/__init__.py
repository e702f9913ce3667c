"""Stores, segments and benchmark-row files."""
