"""Array-and-metadata analytics on Spark DataFrames."""
