"""lithic: a Spark-native engine for source-code analytics."""
