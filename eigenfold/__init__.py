"""Spectral and matrix analytics over Spark DataFrames."""
