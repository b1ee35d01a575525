"""Scans, identities and listings."""
