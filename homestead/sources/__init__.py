"""Scans and sinks for delimited text, key-value text and column stores."""
