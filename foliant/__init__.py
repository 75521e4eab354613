"""foliant: a PySpark-native analytics engine for digitised document archives."""
