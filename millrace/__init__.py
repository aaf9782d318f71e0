"""Spark-native document and conversation analytics: every operator is DataFrame in, DataFrame (or Column) out."""
