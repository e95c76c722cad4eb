"""Registry analytics as functions on Spark DataFrames."""
