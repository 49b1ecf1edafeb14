"""Relational forms of the document-processing operators."""
