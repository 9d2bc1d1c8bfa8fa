"""Operators for preparing training text: quality, private data, hosts, tokens, duplicates, toxicity, extraction."""
