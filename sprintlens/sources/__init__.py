"""Sources of the effort-analytics engine."""
