"""Queries of the catalogue, over the standard tables."""
