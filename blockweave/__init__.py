"""Spark-native engine for synthetic household microdata and the statistics around it."""
