"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage; the entry module adds its
queries only where it is present.
"""
