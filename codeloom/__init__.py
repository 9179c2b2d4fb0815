"""codeloom: code-review analytics on Spark DataFrames."""
