"""lexmill - a PySpark-native engine for preparing, searching and checking legal text."""

__version__ = "0.1.0"
