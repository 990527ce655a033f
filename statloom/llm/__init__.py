"""Training-data operators (URL filters, PII, sharding, tokenisation, ...).

Nothing else in the library imports this subpackage.
"""
