"""gridloom: N-dimensional array analytics expressed as Spark DataFrames."""
