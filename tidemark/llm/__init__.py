"""Operators for preparing training text: extraction, packing, language
identification, chat formatting, near-duplicates, media containers, sharding,
decontamination, quality scoring and licence lookup.

Nothing outside this subpackage imports it.
"""
