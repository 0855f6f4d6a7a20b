"""Skein: conversation analytics on Spark DataFrames."""
