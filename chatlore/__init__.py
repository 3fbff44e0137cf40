"""Spark-native search and analytics over an append-only message archive."""
