"""Network-traffic analytics on Spark DataFrames."""
