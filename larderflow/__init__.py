"""Spark-native tables and derivations for household meal and grocery data."""
