"""Spark-native security log analytics: raw auth lines in, reviewed cases out."""
