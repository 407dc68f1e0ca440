"""Spark-native analytics over branch-heavy version histories of byte states."""
