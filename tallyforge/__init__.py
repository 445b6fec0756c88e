"""A Spark-native analytics library: null-safe and interval joins, segmentation, ranking, valuation, models."""
