"""Public-records analytics as Spark DataFrames."""
