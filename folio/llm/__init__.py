"""Operators for training-data pipelines; nothing else in folio imports this subpackage."""
