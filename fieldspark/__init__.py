"""Spark-native gridding and local regression of irregular observations."""
