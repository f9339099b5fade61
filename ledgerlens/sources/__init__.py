"""Scans, sinks and the snapshot store."""
