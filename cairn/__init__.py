"""Spark-native operators for point-cloud maps, robot logs and pose graphs."""
