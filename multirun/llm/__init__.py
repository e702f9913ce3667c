"""Operators for preparing training data, over documents, pages and benchmark items."""
