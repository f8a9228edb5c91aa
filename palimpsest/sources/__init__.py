"""Readers and writers of the memory engine's files."""
