"""Functions of the citation-graph engine."""
