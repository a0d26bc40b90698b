"""Lectern: scholarly-search analytics on Spark DataFrames."""
