"""A Spark-native engine that finds, verifies and replaces personal information in documents."""
