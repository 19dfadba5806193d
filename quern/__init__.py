"""quern: a retrieval and memory analytics engine on Spark DataFrames."""
