"""Training-data operators: decontamination, mixing, deduplication, search, scoring and token output.

Nothing else in the package imports this subpackage.
"""
