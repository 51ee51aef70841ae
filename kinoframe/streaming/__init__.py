"""Structured Streaming forms of reports."""
