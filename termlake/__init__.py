"""termlake: evidence-backed multilingual terminology as Spark DataFrames."""
