"""Marketplace data-quality and analytics operators on Spark DataFrames.

Sub-packages
------------
functions   column expressions (time, text, classification, statistics)
operators   DataFrame -> DataFrame building blocks (grain, rank, quality, agreement)
sources     declared schemas, readers and writers
plans       marketplace data products composed from the operators
bindings    the same products over the star-schema test tables, with SQL oracles
"""
