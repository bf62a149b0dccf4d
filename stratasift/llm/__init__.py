"""Operators for preparing language-model training data.

Nothing outside this package imports it; the top-level entry module adds its
queries only when the package is present.
"""
