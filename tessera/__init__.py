"""tessera: retrieval, conversation and time-series analytics on Spark DataFrames."""
