"""Incremental (batch resume) operators."""
