"""A multi-model analytics library over Spark DataFrames."""
