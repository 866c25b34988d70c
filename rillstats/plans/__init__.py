"""Declarations of statistics and how they run."""
