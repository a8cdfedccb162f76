"""Newsloom: Spark-native analysis of who said what in large news collections."""
