"""Operators of a training-data pipeline: text in, DataFrames out."""
