"""Operators that prepare text collections for model training. Nothing else in the library imports them."""
