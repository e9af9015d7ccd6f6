"""Relational, resolution and history operators (DataFrame in, DataFrame out)."""
