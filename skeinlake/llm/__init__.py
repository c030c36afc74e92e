"""Operators of a training-data pipeline: one module each, plus ``common`` and ``queries``.

Nothing else in the library imports this subpackage.
"""
