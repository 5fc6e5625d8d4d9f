"""Deterministic structural graph analytics on Spark DataFrames."""
