"""Column functions: everything here is a built-in Catalyst expression, no Python UDF."""
