"""Spark-native reconciliation of official-statistics style tables."""
