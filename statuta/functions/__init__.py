"""Column functions: text, tokens and dates."""
