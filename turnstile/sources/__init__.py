"""Sources of the visitor-analytics engine."""
