"""Reusable plan shapes: running aggregates and block scans over a global order."""
