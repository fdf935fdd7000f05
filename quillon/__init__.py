"""quillon: a PySpark-native query and search engine."""
