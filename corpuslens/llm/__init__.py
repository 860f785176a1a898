"""Operators that prepare training text: duplicates, quality, secrets, archives, packing."""
