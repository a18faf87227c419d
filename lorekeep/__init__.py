"""Text snippets in, a searchable and duplicate-free knowledge table out, on Spark DataFrames."""
