"""Relational operators: extraction, linking, adjudication, rules, grading, review."""
