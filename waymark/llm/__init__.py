"""Operators for building training data sets. Nothing else in the library imports this subpackage."""
