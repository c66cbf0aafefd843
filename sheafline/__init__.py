"""Ordered, semi-structured data on Spark: collections, document queries, running state, text comparison."""
