"""Training-data operators: dedup, decontamination, tokenisation, extraction, sharding, scoring.

Nothing else in the package imports this subpackage.
"""
