"""A Spark-native analytics engine for tabular and panel data."""
