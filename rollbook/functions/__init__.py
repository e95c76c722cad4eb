"""Column functions: text, typed parsing and predicates."""
