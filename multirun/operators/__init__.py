"""Relational operators over operation logs, live runs and dictionaries."""
