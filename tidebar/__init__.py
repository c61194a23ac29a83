"""tidebar: market analytics on Spark DataFrames."""
