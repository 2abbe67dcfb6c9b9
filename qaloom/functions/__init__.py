"""Column functions: text parsing, keys, statistics."""
