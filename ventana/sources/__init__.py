"""Scans, keyed stores and sinks."""
