"""Column functions: portable draws, criteria, projections, special functions."""
