"""Training-data operators: deduplication, language, safety, decontamination, mixing.

Nothing outside this subpackage imports it.
"""
