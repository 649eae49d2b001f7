"""Operators for preparing language-model training corpora.

Self-contained: nothing outside this subpackage imports it, and it imports
nothing from the rest of the library.
"""
