"""wickline: a PySpark-native engine for bitemporal candlestick series."""
