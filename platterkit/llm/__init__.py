"""Operators that prepare catalogue text as training data. Nothing else in the library imports this subpackage."""
