"""Catalog analytics on Spark: DataFrame operators, column functions, sources, sinks and streaming jobs."""
