"""Spark-native authorship and text-pair analytics engine."""
