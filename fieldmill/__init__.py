"""fieldmill: a Spark-native engine for tables of points, features, masks, graphs and run results."""
