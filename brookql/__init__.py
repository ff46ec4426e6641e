"""A flow-style query language and engine on Spark DataFrames."""
