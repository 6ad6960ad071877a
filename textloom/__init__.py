"""textloom: a PySpark-native engine for building, searching and cleaning text corpora."""
