"""Operators on text corpora for training data. Nothing outside this subpackage imports it."""
