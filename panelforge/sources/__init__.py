"""Readers, sinks and payload parsers."""
