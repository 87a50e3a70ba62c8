"""almanac: a PySpark-native engine for recurring-event listings."""
