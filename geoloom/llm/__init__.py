"""Operators that prepare training data. Nothing else in geoloom imports this package."""
