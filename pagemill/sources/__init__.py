"""Readers and writers: page records, book Markdown, bibliographies, hint files, catalogs."""
