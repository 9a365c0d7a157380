"""The named queries, each a function that returns a DataFrame."""
