"""Training-data operators: token files, tokenizers, scans, near-duplicates, mixing.

Nothing outside this subpackage imports it.
"""
