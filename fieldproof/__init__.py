"""Record quality on Spark: clean, resolve, qualify, score and explore records as DataFrames."""
