"""Operators for preparing training text at scale: language, quality, duplicates, mixing, search and tokens."""
