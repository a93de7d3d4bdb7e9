"""Readers, writers and the adapters for the sample tables."""
