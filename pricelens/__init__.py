"""Equity price and news analytics on Spark DataFrames."""
