"""Operators of a training-data pipeline (documents, pages, conversations).

Nothing else in the library imports this subpackage; it uses the library's
session helpers only."""
