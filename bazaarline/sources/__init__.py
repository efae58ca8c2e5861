"""Scans of pages, JSON and logs into listing rows, and report sinks."""
