"""Operators that prepare text corpora for model training.

Nothing outside this package imports it.  Every operator takes a DataFrame with at least
``doc_id`` and ``text`` and states in its docstring what it does with nulls, empty texts,
repeated rows and extra columns.
"""
