"""brindle: a PySpark-native engine for text, facts and run metrics."""
