"""Operators of a training-data pipeline (one module each).

Nothing else in the library imports this subpackage; its queries are
registered by ``__spark_entry__.py`` when it can be imported.
"""
