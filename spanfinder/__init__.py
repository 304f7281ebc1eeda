"""Moment search and retrieval evaluation on Spark."""
