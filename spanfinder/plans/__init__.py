"""Whole jobs composed from operators: planning, search, indexing, timeline, evaluation."""
