"""Operators of a training-data pipeline: ten text and vector operators over Spark tables."""
