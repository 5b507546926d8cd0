"""Operators for large-scale training-data preparation.

Self-contained: nothing else in the library imports this subpackage, and it
can be removed without affecting the image-curation operators.
"""
