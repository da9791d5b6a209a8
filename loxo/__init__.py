"""loxo: straight-line corridor analytics as Spark DataFrames."""
