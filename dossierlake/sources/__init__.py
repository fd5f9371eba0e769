"""Scans, logical tables and sinks."""
