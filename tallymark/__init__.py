"""Source-containment analytics on Spark DataFrames."""
