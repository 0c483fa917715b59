"""PySpark-native genealogical analytics engine."""
