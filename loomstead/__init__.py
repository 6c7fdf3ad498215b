"""Spark-native operators for annotated text corpora and the authority data around them."""
