"""Operators for preparing language-model training text at scale.

Nothing outside this folder imports it. Every operator takes DataFrames and returns a DataFrame; the
registered queries and their SQL are in ``registry``.
"""
