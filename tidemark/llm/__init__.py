"""Operators that prepare text, vector, archive and chat data for model training.

Nothing else in the package imports this subpackage.
"""
