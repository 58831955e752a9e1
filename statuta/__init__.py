"""Statuta: a PySpark-native engine for collections of hierarchical legal documents."""

__version__ = "0.1.0"
