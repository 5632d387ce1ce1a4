"""Operators for language-model training corpora. Nothing else in the library imports them."""
