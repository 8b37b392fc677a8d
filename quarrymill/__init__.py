"""A PySpark engine for the quality, originality and ranking of conversation datasets and the programs that make them."""
