"""Column functions: NULL rules, scalar helpers, special functions and tail probabilities."""
