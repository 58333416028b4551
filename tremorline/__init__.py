"""Tremorline: sensor time-series analytics on Spark DataFrames."""
