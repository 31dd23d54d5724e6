"""functions of the memory engine."""
