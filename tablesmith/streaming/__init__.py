"""Cleaning of streaming tables."""
