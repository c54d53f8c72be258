"""Training-data operators: fingerprints, archives, classifiers, tokens, dedup, packing, chat.

Nothing else in the library imports this subpackage.
"""
