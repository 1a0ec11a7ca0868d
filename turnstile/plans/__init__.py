"""Plans of the visitor-analytics engine."""
