"""Kinfold: individual-based population genetics as Spark DataFrames."""
