"""Panel operators grouped by topic."""
