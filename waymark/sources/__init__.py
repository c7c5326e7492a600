"""Readers, writers and the adapters of the test tables."""
