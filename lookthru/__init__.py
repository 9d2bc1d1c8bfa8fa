"""Fund-holdings transparency on Spark: every operator takes and returns DataFrames."""
