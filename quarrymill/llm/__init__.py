"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Every module holds one operator with a general interface; `queries` binds each of them to the
columns that its query returns.
"""
