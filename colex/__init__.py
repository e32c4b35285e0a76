"""colex: a PySpark-native engine for phrase lexicons, dictionaries and discourse annotation."""
