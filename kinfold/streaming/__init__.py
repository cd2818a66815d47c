"""Streaming forms of the interval counters."""
