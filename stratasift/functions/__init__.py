"""Column expressions: text, identifiers, access masks, vectors, rules and redaction."""
