"""Operators for large training corpora: tokens, quality, near copies, secrets, fingerprints.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
