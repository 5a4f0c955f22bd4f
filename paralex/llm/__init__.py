"""Operators for training-data pipelines: tokenising, packing, search, sharding,
near-duplicate links, classifiers, token files, URL filters and media columns.

Nothing outside this subpackage imports it; the package root stays usable when
this folder is removed.
"""
