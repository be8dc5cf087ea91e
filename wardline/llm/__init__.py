"""Operators for large training corpora: near-duplicates, personal data, scoring, mixing, language, leaks, quality, chat."""
