"""PySpark-native analytics over gridded, time-dependent data."""
