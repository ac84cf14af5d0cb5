"""Span-level provenance analytics on Spark."""
