"""Operators for preparing training data, built apart from the rest of the library."""
