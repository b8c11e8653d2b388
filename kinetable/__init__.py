"""Episodic time-series tables on Spark DataFrames."""
