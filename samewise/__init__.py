"""samewise: a PySpark-native entity-resolution and record-deduplication engine."""

__version__ = "0.1.0"
