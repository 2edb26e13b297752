"""Training-data operators: deduplication, language ID, mixing, byte-level BPE and PII.

Nothing outside this subpackage imports it.
"""
