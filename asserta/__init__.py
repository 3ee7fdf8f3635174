"""A Spark-native engine over immutable facts."""
