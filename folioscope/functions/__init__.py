"""Column functions: text, analysis, query understanding, citations."""
