"""Column functions: text, scores, dates, keys."""
