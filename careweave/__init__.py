"""careweave: Spark-native reconciliation of hospital admission signals."""
