"""Incremental maintenance of the index."""
