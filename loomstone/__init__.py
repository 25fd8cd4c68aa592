"""A Spark-native engine for document corpora and the operational data around them."""
