"""Spark-native operators that turn event records and news texts into analysis tables."""
