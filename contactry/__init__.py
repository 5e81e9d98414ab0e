"""Contact and demand analytics on Spark DataFrames."""
