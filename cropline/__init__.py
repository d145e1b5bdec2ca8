"""Crop production, market price and rainfall analytics on Spark DataFrames."""
