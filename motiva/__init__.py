"""Graph-pattern analytics on Spark DataFrames."""
