"""Analytical and cleaning operators: functions from DataFrames to a DataFrame."""
