"""Operators for training data, their queries and checks. Nothing else in the library imports this."""
