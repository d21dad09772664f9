"""Independent SQL of every registered query, for checking results with DuckDB."""
