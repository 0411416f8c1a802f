"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each module holds one operator with
its own interface; ``queries`` derives the registered result tables from them.
"""
