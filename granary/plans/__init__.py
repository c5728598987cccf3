"""Queries that the entry module registers."""
