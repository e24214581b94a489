"""Readers, writers and the mapping from the benchmark tables."""
