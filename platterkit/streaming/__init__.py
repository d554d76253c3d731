"""streaming of the platterkit engine."""
