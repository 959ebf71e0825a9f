"""Stop-variant and training-data operators on Spark DataFrames."""
