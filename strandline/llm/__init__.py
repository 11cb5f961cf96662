"""Operators for preparing large language-model training corpora.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
