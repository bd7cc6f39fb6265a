"""Diagnostic classification analytics on Spark DataFrames."""
