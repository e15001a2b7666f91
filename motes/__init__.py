"""Particle and spatial-interaction analytics on Spark DataFrames."""
