"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each module holds one operator with
its own interface; ``queries`` binds them to the registered ``opN_`` queries.
"""
