"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` binds them to the test tables. Nothing
else in the library imports this subpackage.
"""
