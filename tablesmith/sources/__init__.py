"""Readers and writers of tables."""
