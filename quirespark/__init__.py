"""Document preparation and hybrid retrieval on Spark: every operator is a DataFrame or Column transform."""
