"""Streaming forms of the grouped statistics."""
