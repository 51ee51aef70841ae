"""Operators on traces and blocks."""
