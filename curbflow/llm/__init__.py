"""Operators for preparing language-model training data on Spark.

Nothing outside this folder imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries.py`` holds the thin contract queries.
"""
