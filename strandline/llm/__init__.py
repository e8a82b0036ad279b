"""Training-data operators: dedup, tokenisation, decontamination, filtering, search and extraction.

Nothing outside this subpackage imports it.
"""
