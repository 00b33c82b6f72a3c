"""Operators for building language-model training data on Spark.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
