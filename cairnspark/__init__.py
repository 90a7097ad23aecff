"""cairnspark: archive analytics as Spark DataFrames."""
