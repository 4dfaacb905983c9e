"""Spark-native search and analytics over time-segmented media."""
