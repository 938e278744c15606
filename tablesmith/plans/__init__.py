"""Whole jobs made of operators: pipelines, profiles, validation, insights, reports, SQL."""
