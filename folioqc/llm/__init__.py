"""Corpus operators: personal data, deduplication, tokenization, mixing, classifiers, extraction.

Nothing outside this subpackage imports it.
"""
