"""Column functions: indicators, normalisers, costs, rules."""
