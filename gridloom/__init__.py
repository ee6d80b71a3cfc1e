"""Spark-native analytics over tiled images, patch tables, label sets and graphs."""
