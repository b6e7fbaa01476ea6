"""docloom: retrieval, document-graph and corpus-curation operators on Spark DataFrames."""
