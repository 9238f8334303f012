"""framelake: DataFrame operators for media catalogs, written for Spark."""
