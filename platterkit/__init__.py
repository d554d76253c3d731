"""platterkit: a PySpark-native engine for querying and enriching a record-collection catalogue."""
