"""Atlas-guided annotation of large count matrices on Spark DataFrames."""
