"""Operators for preparing language-model training data, each by its own method over DataFrames."""
