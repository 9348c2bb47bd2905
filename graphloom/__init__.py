"""Concept graphs from document collections, on Spark DataFrames."""
