"""Relational operators over the stored tables."""
