"""Transcript and caption data jobs on Spark DataFrames."""
