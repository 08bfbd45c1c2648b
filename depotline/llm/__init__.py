"""Operators for preparing language-model training data, each in a module of its own.

Nothing else in the library imports this subpackage.
"""
