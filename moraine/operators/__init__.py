"""Operators of the document store, log, fleet, catalogues, key-value stores and listings."""
