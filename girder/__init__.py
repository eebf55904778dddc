"""girder: a PySpark-native analytics engine for building-information models."""

__version__ = "0.1.0"
