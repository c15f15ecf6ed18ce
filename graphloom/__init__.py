"""graphloom: typed graph-pattern queries and corpus processing on Spark DataFrames."""
