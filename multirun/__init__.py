"""Ordered key-to-multivalue analytics on Spark DataFrames."""
