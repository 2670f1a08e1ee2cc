"""Audit and document analytics expressed as Spark plans."""
