"""Queries: declarative plans over the tables."""
