"""loomstone: multi-model analytics on Spark DataFrames."""
