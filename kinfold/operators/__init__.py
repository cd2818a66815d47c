"""Operators on people, genomes and populations: DataFrames in, DataFrames out."""
