"""trendloom: Spark-native analytics for trending content."""
