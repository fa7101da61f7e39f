"""Repeatable, inspectable analyses over versioned tables, on Spark DataFrames."""
