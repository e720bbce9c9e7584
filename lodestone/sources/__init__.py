"""Readers and writers of corpora, chunk tables and catalogs."""
