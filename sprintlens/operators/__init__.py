"""Operators of the effort-analytics engine."""
