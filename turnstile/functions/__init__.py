"""Functions of the visitor-analytics engine."""
