"""Spark-native analytics for environmental noise: spatial joins, trajectories, level arithmetic, data repair."""
