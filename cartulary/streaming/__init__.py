"""Continuous and repeated ingest."""
