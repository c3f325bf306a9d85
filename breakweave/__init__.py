"""Spark-native interval analytics: evidence, overlap joins, clustering and call merging on DataFrames."""
