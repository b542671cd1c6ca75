"""Spark-native engine for curating, pairing and evaluating agent-trajectory data."""
