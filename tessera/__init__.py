"""Spark-native dataset curation, decontamination and evaluation engine."""
