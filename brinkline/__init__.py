"""A Spark-native engine for threshold analytics over scored task records."""
