"""Operators that turn media texts into training data. Nothing else in the library imports this package."""
