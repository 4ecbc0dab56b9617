"""Operators for preparing language-model training data; nothing else in loomdoc imports this subpackage."""
