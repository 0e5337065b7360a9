"""Relational operators over the typed photo index."""
