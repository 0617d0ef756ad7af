"""Full-text search and ranking over nested JSON documents and flat tables, as Spark DataFrames."""
