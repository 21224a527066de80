"""Whole jobs put together from operators: indexing, searching, assembling, auditing."""
