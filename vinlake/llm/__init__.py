"""Training-data operators: classifiers, near-duplicates, search, mixing, tokenizers and filters.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
