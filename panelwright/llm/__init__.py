"""Operators for large training-data pipelines: near-duplicates, quality, packing, tokens, classifiers.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
