"""Mergeable streaming statistics as PySpark plans."""
