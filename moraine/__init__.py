"""A PySpark-native library of document-store, fleet-state, catalogue and key-value analytics."""

__version__ = "0.1.0"
