"""Analytic operators: every one takes and returns Spark DataFrames."""
