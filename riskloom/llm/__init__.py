"""Operators of a training-data pipeline, with their registered queries and SQL in queries.py."""
