"""Spark-native analytics over source code, dependencies, infrastructure files and text."""
