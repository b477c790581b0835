"""Knowledge-graph memory analytics on Spark DataFrames."""
