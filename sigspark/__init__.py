"""Spark-native analytics over series, frames, tables and text."""
