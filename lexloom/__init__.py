"""Spark operators for building, searching and evaluating document collections."""
