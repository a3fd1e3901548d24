"""Operators of a training-data pipeline: each module holds one operator.

Nothing else in the package imports this subpackage; its queries are in
``queries.py`` and the entry point adds them when the subpackage is present.
"""
