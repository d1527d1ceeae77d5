"""Column expressions: time of day, missing values, tails of distributions."""
