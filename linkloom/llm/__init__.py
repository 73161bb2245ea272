"""Operators for training-data pipelines, each over DataFrames and free of the rest of the library's rules."""
