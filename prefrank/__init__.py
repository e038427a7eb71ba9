"""Preference ranking and model evaluation on Spark DataFrames."""
