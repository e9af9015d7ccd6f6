"""Structured Streaming operators and their batch equivalents."""
