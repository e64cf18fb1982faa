"""Privacy analytics over text and traffic, on Spark."""
