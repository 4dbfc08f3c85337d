"""lingoweave: Spark-native processing of localisation text and training data."""
