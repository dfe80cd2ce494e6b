"""Retrieval and memory analytics over partitioned collections of text patterns, on Spark."""
