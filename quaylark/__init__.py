"""quaylark: a PySpark-native engine for news and market analytics."""
