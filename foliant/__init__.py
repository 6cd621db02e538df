"""foliant: a document analytics engine on Spark DataFrames."""
