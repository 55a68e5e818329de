"""Quernstone: a PySpark-native analytics engine for queues of consumer cases."""
