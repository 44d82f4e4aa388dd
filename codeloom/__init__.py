"""Codeloom: code-graph analytics and text-corpus processing on Spark DataFrames."""
