"""Batch evaluation analytics for text-safety detectors on Spark DataFrames."""
