"""Readers, writers and saved stages."""
