"""Composite pipelines and the catalog of queries with their SQL oracles."""
