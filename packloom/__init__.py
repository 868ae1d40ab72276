"""Corpus packing and expert-ensemble analytics, expressed as Spark DataFrame plans."""
