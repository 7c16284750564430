"""Particle-packing analytics on Spark DataFrames."""
