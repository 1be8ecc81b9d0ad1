"""Spark-native operators for tensors, federated aggregation, vector search and event coordination."""
