"""Spark-native analytics over sparse count matrices, and corpus operators in ``tallyloom.llm``."""
