"""Operators for preparing training text: formatting, deduplication, tokens, archives, privacy.

Nothing outside this subpackage imports it; it can be removed as a folder.
"""
