"""Operators for preparing large text corpora: quality, duplicates, leaks, mixing, tokens and private data."""
