"""Byte-level scalar functions and deterministic generators."""
