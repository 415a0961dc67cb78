"""Readers: model files, archives, workbooks and delimited text."""
