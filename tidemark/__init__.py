"""Behavioural time series on Spark: readings, health, rhythm and sleep features, cleaning, statistics and models."""
