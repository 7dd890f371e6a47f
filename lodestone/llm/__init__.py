"""Operators for training-data problems on text; nothing else in the library imports this subpackage."""
