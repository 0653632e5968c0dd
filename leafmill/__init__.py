"""leafmill: document-processing analytics expressed on Spark DataFrames."""
