"""freshet: catchment time-series analytics on Spark DataFrames."""
