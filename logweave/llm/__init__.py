"""Operators for large text corpora.

Nothing else in the package imports this subpackage; ``__spark_entry__.py``
adds its queries only if it can be imported.
"""
