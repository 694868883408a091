"""Column builders for vectors and scores."""
