"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; it can be deleted without
affecting the rest of the library.
"""
