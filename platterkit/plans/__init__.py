"""plans of the platterkit engine."""
