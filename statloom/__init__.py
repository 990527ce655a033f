"""Statistics, econometrics and data preparation on Spark DataFrames."""
