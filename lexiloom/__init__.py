"""Corpus analytics on PySpark: tokens, vocabularies, TF-IDF, topic models, layouts and small linear algebra."""
