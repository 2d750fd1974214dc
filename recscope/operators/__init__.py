"""Operators on DataFrames: re-assembly, joins with the dimensions, order and navigation, statistics and retention."""
