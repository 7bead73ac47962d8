"""Analytics engine for caption pipelines, on Spark DataFrames."""
