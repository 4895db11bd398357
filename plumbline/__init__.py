"""Plumbline: data profiling, rule based quality measurement and observability on Spark DataFrames."""
