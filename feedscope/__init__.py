"""feedscope: news and document feeds as Spark DataFrames."""
