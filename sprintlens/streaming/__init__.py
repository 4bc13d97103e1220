"""Streaming of the effort-analytics engine."""
