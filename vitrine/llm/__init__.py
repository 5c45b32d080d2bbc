"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface and the thin ``opN_<name>`` query that
derives the contract's columns from it.
"""
