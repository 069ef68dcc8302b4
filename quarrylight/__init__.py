"""Document search, crawl analytics and text processing on Spark DataFrames."""
