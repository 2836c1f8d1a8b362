"""Operators on text and code for training data. Nothing outside this subpackage imports it."""
