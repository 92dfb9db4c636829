"""Script-corpus analytics on Spark DataFrames."""
