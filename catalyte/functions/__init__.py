"""Column functions: text, fuzzy names, colours, scores."""
