"""Composite plans: benchmark-suite statistics and range planning."""
