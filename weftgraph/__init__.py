"""Spark-native analytics over large property graphs and their query logs."""
