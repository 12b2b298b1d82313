"""Relational operators: document model, matching, merging, redaction, review."""
