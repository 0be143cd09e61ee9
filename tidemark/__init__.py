"""Temporal statistics of keyed time series on Spark."""
