"""Spark-native analytics for recorded vehicle-sensor sessions."""
