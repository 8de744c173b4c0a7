"""Readers, line parsers and sinks."""
