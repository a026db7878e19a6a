"""Vecstrand: a Spark-native analytics engine for corpora of versioned, de-duplicated embedding vectors."""
