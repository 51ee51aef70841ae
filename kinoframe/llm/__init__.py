"""Operators for preparing language-model training data; stands alone."""
