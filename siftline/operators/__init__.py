"""Relational operators: flattening, index tables, matching, combination, results."""
