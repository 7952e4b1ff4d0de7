"""Block-compressed texture analytics on Spark DataFrames."""
