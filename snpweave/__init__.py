"""Population-genomics analytics on Spark DataFrames."""
