"""garim: a PySpark-native engine that finds, scores and masks personal data."""
