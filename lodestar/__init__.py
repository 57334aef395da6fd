"""Lodestar: instance retrieval and metric learning on Spark DataFrames."""
