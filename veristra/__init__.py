"""Veristra: a Spark-native retrieval-analytics engine."""
