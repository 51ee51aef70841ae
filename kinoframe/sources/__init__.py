"""Readers and writers of traces, logs, manifests and reports."""
