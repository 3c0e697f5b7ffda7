"""quern: a PySpark-native engine for document corpora, entity names and text search."""
