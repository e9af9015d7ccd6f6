"""Readers and writers: driver tables, files as bytes, archives, upserts."""
