"""Operators on text corpora, links and large numeric columns for training data.

Nothing else in the library imports this subpackage.
"""
