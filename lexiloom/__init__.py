"""Corpus preparation and tokenizer-fairness analytics as Spark DataFrame operators."""
