"""Whole flows, and the registry of named queries over the sample tables."""
