"""Spark-native code-graph analytics: declarative operators over graph tables."""
