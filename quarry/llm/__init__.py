"""Operators for preparing language-model training data. Nothing else in quarry imports this package."""
