"""Operators for training-data pipelines; nothing else in the library imports this package.

One module per operator. ``queries`` registers the query of each and the SQL it must agree with.
"""
