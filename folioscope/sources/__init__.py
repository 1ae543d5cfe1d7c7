"""Readers and writers of documents, indexes and evaluation sets."""
