"""Spark-first engine for file catalogues, event logs and text corpora.

Every public operator is a function from DataFrames to a DataFrame; nothing
in the package creates a session on import.
"""
