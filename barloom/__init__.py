"""barloom: a PySpark-native analytics engine for market time series."""

__version__ = "0.1.0"
