"""siltstone: a PySpark-native engine for analysing lakehouse tables."""
