"""Operators for building language-model training data from document tables.

Each module holds one operator with its own general interface; ``queries``
registers the thin queries that apply them to the driver's tables.
"""
