"""Operators over messages, segments and stored references: DataFrames in, DataFrames out."""
