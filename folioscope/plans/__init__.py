"""Whole pipelines composed of operators, and the query registry."""
