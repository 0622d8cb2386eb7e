"""Operators of a training-data pipeline, one module each, with their queries.

Nothing else in the package imports this subpackage.  ``registry.py`` lists
the registered queries; ``__spark_entry__.py`` adds them when the folder is
there.
"""
