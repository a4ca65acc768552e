"""Column functions: text, parsing, metrics, keyed randomness, distributions."""
