"""Readers of documents and tables."""
