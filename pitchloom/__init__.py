"""PySpark-native analytics for tonic-relative pitch time series."""
