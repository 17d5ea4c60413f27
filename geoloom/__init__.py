"""geoloom: a PySpark-native engine for large tables of satellite-tile embeddings."""

__version__ = "0.1.0"
