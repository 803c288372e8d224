"""Strandloom: sequence and sequence-graph analytics on Spark DataFrames."""
