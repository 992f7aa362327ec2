"""Commerce and advertising analytics on Spark DataFrames."""
