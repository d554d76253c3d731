"""functions of the platterkit engine."""
