"""Spark-native analytics for located objects, edges and time-stamped operations."""
