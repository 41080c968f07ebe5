"""Functions and dialect rules over Spark SQL."""
