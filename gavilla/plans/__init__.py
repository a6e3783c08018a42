"""Composed end-to-end runs."""
