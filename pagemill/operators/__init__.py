"""Joins, windows, folds and stateful steps over page and chunk tables."""
