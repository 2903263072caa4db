"""Column functions: patterns, lines, tokens, scores and vectors."""
