"""Evidence search and corpus analytics on Spark DataFrames."""
