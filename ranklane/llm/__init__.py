"""Operators for building training corpora: near-duplicates, tokens, personal data, filters and mixing."""
