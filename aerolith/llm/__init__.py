"""Operators that prepare training data for language models.

Each module is one operator with a general interface; ``queries`` registers the
thin ``opN_<name>`` queries over them. Nothing else in the library imports this
subpackage.
"""
