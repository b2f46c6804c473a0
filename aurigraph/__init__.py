"""Spatial-cue measurement and answer-verification analytics on Spark DataFrames."""
