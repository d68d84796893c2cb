"""Whole reports and the catalogue of queries over a star schema."""
