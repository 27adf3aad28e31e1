"""Structured Streaming intake of comparison jobs."""
