"""Spark-first engine for judging and curating large text corpora."""
