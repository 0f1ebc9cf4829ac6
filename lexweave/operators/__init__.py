"""Operators of the citation-graph engine."""
