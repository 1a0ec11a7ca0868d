"""Operators of the visitor-analytics engine."""
