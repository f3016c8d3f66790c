"""Operators for preparing text corpora as training data.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
