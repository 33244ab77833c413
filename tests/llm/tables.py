"""Schemas that the tests of this folder share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
