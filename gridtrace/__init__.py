"""Particle tracing, block decomposition and spatial reductions on Spark DataFrames."""
