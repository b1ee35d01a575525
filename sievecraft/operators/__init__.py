"""Relational operators: reconciliation, dedup, naming, quality, validation."""
