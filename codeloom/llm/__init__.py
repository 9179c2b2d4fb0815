"""Operators that prepare training text and code; nothing outside this package imports it."""
