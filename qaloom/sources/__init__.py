"""Readers and writers of the corpus file formats."""
