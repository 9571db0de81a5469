"""Spark-native analytics over versioned facts, graphs and text."""
