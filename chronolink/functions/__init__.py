"""Column expressions: tails of distributions, safe statistics, window recipes."""
