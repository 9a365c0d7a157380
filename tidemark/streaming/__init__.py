"""Structured Streaming: the classifier with state, and the sinks."""
