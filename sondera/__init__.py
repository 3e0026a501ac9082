"""A search and aggregation engine on Spark DataFrames."""
