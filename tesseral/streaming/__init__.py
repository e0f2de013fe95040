"""Operators on streams of calls."""
