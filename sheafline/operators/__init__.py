"""Operators over arrays, dictionaries and DataFrames that carry an explicit order."""
