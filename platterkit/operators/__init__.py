"""operators of the platterkit engine."""
