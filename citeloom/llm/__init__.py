"""Operators for preparing training data, and the registered queries that apply them."""
