"""Corpus and retrieval analytics as Spark plans."""
