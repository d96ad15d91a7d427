"""quire: Word-document analytics as Spark DataFrames."""
