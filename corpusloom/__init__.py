"""corpusloom: corpus engineering on Spark DataFrames."""
