"""Column expressions: text, scores, page geometry."""
