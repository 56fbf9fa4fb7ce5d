"""Training-data operators: extraction, filtering, deduplication, tokenisation.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
registered queries; every operator module keeps a general interface.
"""
