"""millrace: a PySpark-native engine for curating and evaluating training data."""
