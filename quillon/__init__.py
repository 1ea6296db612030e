"""quillon: record linkage and text standardisation on Spark DataFrames."""
