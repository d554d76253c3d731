"""sources of the platterkit engine."""
