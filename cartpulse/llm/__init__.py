"""Operators for preparing language-model training data.

Each module is one operator with its own general interface; ``queries``
holds the thin ``opN_<name>`` queries over the test tables and their SQL.
Nothing else in the library imports this subpackage.
"""
