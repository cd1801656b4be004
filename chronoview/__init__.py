"""Point-in-time record analytics on PySpark."""
