"""Column builders and document functions."""
