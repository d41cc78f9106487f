"""Operators for text corpora that train language models.

Nothing else in the library imports this subpackage.  ``catalog`` holds one
query per operator and, where SQL can express it, its SQL.
"""
