"""Sources of the citation-graph engine."""
