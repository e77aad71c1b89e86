"""Whole runs: cleaning a dataset folder, staging prices, building the load file."""
