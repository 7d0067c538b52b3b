"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` applies them to the tables of a data folder and ``sql`` holds
the equivalent SQL where there is one.  Nothing outside this subpackage imports it.
"""
