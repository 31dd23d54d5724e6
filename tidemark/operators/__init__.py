"""operators of the memory engine."""
