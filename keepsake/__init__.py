"""keepsake: knowledge-record analytics and retrieval on Spark DataFrames."""
