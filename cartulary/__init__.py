"""Geographically scoped document analytics on Spark DataFrames."""
