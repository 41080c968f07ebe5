"""Operators for preparing language-model training data at scale.

Nothing else in ``sqlloom`` imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the registered results.
"""
