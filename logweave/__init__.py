"""Ordered, partitioned record processing on Spark DataFrames and Structured Streaming."""
