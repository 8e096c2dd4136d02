"""scriptorium: a PySpark-native engine for document extraction, repair and measurement."""
