"""Corpus shaping, pairwise analysis and evaluation as Spark DataFrame operators."""
