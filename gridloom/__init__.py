"""gridloom: gridded fields, iterative numerics and their analytics, as Spark DataFrames."""
