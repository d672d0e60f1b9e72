"""Code-quality analytics on Spark DataFrames."""
