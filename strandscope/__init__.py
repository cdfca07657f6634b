"""Network-exposure and corpus analytics on Spark DataFrames."""
