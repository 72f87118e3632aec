"""A DataFrame-first analytics engine: column functions, relational operators, composition, scoring and statistics."""
