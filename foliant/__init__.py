"""Spark-native extraction of text from PDF documents, and corpus operators."""
