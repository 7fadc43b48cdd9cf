"""corpuscle: corpus analytics on Spark DataFrames."""
