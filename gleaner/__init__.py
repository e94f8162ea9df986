"""gleaner: a Spark-native engine for a vertical web-search collection."""
