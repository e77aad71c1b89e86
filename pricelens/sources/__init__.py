"""File inventories, CSV readers and the writers of cleaned data."""
