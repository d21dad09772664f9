"""Usage analytics for data warehouses, as lazy Spark DataFrames."""
