"""Operators for preparing large language-model training data.

Nothing else in the library imports this subpackage; see ``queries`` for the registered queries.
"""
