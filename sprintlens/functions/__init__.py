"""Functions of the effort-analytics engine."""
