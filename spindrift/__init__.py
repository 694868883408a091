"""Vector search, quantisation and training-data preparation on PySpark."""
