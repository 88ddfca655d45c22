"""Operators for large training-corpus pipelines; nothing else in the package imports them."""
