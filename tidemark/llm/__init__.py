"""Operators for preparing training text: scans, deduplication, mixing, tokens, pages."""
