"""Plans of the effort-analytics engine."""
