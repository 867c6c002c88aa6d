"""Veldspar: a PySpark-native engine for research-lab data and text corpora."""
