"""Streaming of the visitor-analytics engine."""
