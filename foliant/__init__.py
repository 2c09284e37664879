"""Foliant: document-intelligence operators on DataFrames and Spark SQL."""
