"""Technology-signal analytics on Spark DataFrames."""
