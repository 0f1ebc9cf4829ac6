"""Streaming of the citation-graph engine."""
