"""Vocabulary as data."""
