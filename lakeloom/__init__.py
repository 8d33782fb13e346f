"""A lazy query builder and SQL front end that lower to ordinary Spark DataFrames."""
