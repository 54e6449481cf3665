"""quire: a PySpark-native document-processing engine."""
