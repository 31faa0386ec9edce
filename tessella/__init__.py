"""A document, vector, graph and retrieval analytics engine written with Spark DataFrames."""
