"""Column functions. All are built-in Spark expressions; none is a UDF."""
