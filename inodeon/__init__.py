"""Filesystem-metadata analytics on Spark DataFrames."""
