"""tickloom: a PySpark-native engine for order-level market event data."""
