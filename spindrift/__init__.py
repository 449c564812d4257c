"""spindrift: a PySpark-native engine for nested event analytics."""

__version__ = "0.1.0"
