"""Whole queries: arguments in, one plan out."""
