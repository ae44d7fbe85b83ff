"""Analytics over digital-heritage collections as Spark DataFrames."""
