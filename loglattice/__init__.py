"""loglattice: log analytics on Spark DataFrames."""
