"""A PySpark-native engine for accountability data."""
