"""wattloom: preparation and summary of electricity-network data on Spark DataFrames."""
