"""Operators of a training-data pipeline, one module each, on Spark DataFrames.

Nothing else in the library imports this package; ``queries.py`` holds the
registered queries and their DuckDB statements.
"""
